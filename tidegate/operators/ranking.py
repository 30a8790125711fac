"""Exact ranks and cut points by hash prefix.

No operator here sorts a whole group in one task. Counts per hash range say in
which range a rank lies, and only rows of that range are looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import largest, pinned, stable

HASH_DIGITS = 32
STEP = 3                  # 4,096 prefixes per refinement
SIGMAS = 8                # half width of a bracket in standard deviations
ROWS_PER_BUCKET = 1_000_000


def ordered(groups: Sequence[str], *order):
    return Window.partitionBy(*[F.col(g) for g in groups]).orderBy(*order)


def attach(df: DataFrame, facts: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group facts; without groups ``facts`` is one row, attached as constants.

    NULL is a group like any other, so an inner join loses no row whose group has facts.
    """
    if groups:
        named = facts.withColumnsRenamed({g: f"_of_{g}" for g in groups})
        same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
        return df.join(named, same, how).drop(*[f"_of_{g}" for g in groups])
    row = facts.first()
    if row is None:
        return df.where(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema])
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in facts.schema])


def _holding_rank(counted: DataFrame, groups: Sequence[str], by: str) -> DataFrame:
    """Of the running counts per ``by`` value, the one row per group that holds rank k."""
    running = counted.withColumn("_run", F.col("_before") + F.sum("_c").over(ordered(groups, by)))
    return running.where((F.col("_run") >= F.col("k")) & (F.col("_run") - F.col("_c") < F.col("k"))).select(
        *groups, "n", "k", by, "_c", (F.col("_run") - F.col("_c")).alias("_before")
    )


def _cuts(counted: DataFrame, groups: Sequence[str]) -> DataFrame:
    return pinned(
        _holding_rank(counted, groups, "_h").select(
            *groups, "n", "k", F.col("_h").alias("cut"), F.col("_c").alias("ties"),
            (F.col("k") - F.col("_before")).alias("need"),
        )
    )


def hash_cuts(
    df: DataFrame,
    hash_col: Column,
    k: Column,
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per group: rows ``n``, rank ``k`` and the k-th smallest hash as ``cut``.

    ``k`` is an expression over ``n`` and the group columns. ``ties`` rows share
    the cut hash, ``need`` of them are within rank k.

    Rank 0 or less has the empty cut, which no hash reaches; a rank beyond ``n`` is ``n``.

    Hashes are spread evenly, so the k-th of n lies within a few times sqrt(n)
    ranks of k/n. One aggregation counts the rows below that bracket and the
    hashes inside it. Where many copies of one key bend the spread, the cut is
    found by prefix counts instead, which need nothing of the kind.
    """
    groups = list(groups)
    sizes = pinned(df.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("k", F.least(k.cast("bigint"), F.col("n"))))
    none = pinned(sizes.where("k <= 0").select(
        *groups, "n", "k", F.lit("").alias("cut"), F.lit(0).cast("bigint").alias("ties"), F.lit(0).cast("bigint").alias("need")))
    sizes = sizes.where("k > 0")
    share = F.col("k") / F.col("n")
    spread = SIGMAS * F.sqrt(share * (1 - share) / F.col("n")) + 2 / F.col("n")
    brackets = sizes.withColumn("_lo", _hash_at(share - spread)).withColumn("_hi", _hash_at(share + spread))
    base = df.select(*groups, hash_col.alias("_h"))
    bounded = attach(base, pinned(brackets), groups)
    counted = bounded.groupBy(
        *groups, "n", "k",
        F.when(F.col("_h") < F.col("_lo"), "").when(F.col("_h") <= F.col("_hi"), F.col("_h")).otherwise("~").alias("_h"),
    ).agg(F.count("*").alias("_c"), F.lit(0).cast("bigint").alias("_before"))
    cuts = _cuts(counted, groups)
    if not cuts.where(F.col("cut").isin("", "~")).isEmpty():
        cuts = _cuts_by_prefix(base, sizes, groups, rows_per_bucket)
    return cuts if none.isEmpty() else pinned(cuts.unionByName(none))


def _hash_at(share: Column) -> Column:
    """First digits of the hash below which ``share`` of all hashes lie."""
    place = F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * float(16**12 - 1)).cast("bigint")
    return F.lower(F.lpad(F.hex(place), 12, "0"))


def _cuts_by_prefix(base: DataFrame, sizes: DataFrame, groups: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Narrow to the prefix that holds rank k until its rows are few, then to the hash."""
    length = 0
    chosen = sizes.withColumn("_p", F.lit("")).withColumn("_before", F.lit(0).cast("bigint")).withColumn("_c", F.col("n"))
    while True:
        within = attach(base, chosen.drop("_c"), groups).where(F.substring("_h", 1, length) == F.col("_p"))
        if length >= HASH_DIGITS or (length and largest(chosen, "_c") <= rows_per_bucket):
            break
        length = min(HASH_DIGITS, length + STEP)
        counted = within.groupBy(
            *groups, "n", "k", "_before", F.substring("_h", 1, length).alias("_p")
        ).agg(F.count("*").alias("_c"))
        chosen = pinned(_holding_rank(counted, groups, "_p"))
    # equal hashes are counted first, so copies of one key are one row here
    return _cuts(within.groupBy(*groups, "n", "k", "_before", "_h").agg(F.count("*").alias("_c")), groups)


def hash_rank(
    df: DataFrame,
    hash_col: Column,
    groups: Sequence[str] = (),
    out: str = "row_idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 0-based position of each row within its group in hash order.

    Rows are numbered inside (group, hash prefix) and shifted by the rows of
    all smaller prefixes, so a group of any size spreads over its prefixes.
    Many copies of one key share a hash and would stay in one prefix: they are
    spread by a second hash over a materialised row number.
    """
    groups = list(groups)
    hashed = df.withColumn("_h", hash_col)

    def count(rows: DataFrame) -> DataFrame:
        return pinned(rows.groupBy(*groups, "_p").agg(F.count("*").alias("_c")))

    length = 2
    bucketed = hashed.withColumn("_p", F.substring("_h", 1, length))
    counts = count(bucketed)
    excess = largest(counts, "_c")
    if excess > rows_per_bucket:
        while excess > rows_per_bucket and length < 8:
            excess //= 16
            length += 1
        bucketed = hashed.withColumn("_p", F.substring("_h", 1, length))
        counts = count(bucketed)
        if largest(counts, "_c") > 4 * rows_per_bucket:
            bucketed = _spread_copies(bucketed, counts, groups, rows_per_bucket)
            counts = count(bucketed)
    offsets = counts.select(*groups, "_p", (F.sum("_c").over(ordered(groups, "_p")) - F.col("_c")).alias("_offset"))
    if length == 2:
        offsets = pinned(offsets)
    numbered = attach(bucketed, offsets, [*groups, "_p"])
    inside = F.row_number().over(ordered([*groups, "_p"], "_h"))
    return numbered.withColumn(out, (F.col("_offset") + inside - 1).cast("bigint")).drop(
        "_h", "_p", "_offset", "_copy"
    )


def _spread_copies(bucketed: DataFrame, counts: DataFrame, groups: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Give the copies of a hot key their own buckets, right after their prefix."""
    bucketed = stable(bucketed.withColumn("_copy", F.monotonically_increasing_id()))
    crowded = counts.where(F.col("_c") > rows_per_bucket).drop("_c")
    hot = pinned(
        attach(bucketed, crowded, [*groups, "_p"])
        .groupBy(*groups, "_h")
        .agg(F.count("*").alias("_copies"))
        .where(F.col("_copies") > rows_per_bucket)
    )
    second = F.substring(F.md5(F.col("_copy").cast("string").cast("binary")), 1, 4)
    own = F.concat_ws(":", "_h", second)
    return (
        attach(bucketed, hot, [*groups, "_h"], "left")
        .withColumn("_p", F.when(F.col("_copies").isNotNull(), own).otherwise(F.col("_p")))
        .drop("_copies")
    )
