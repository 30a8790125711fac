"""Split, shuffle, batches and mixture samples, all seeded and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import digest, draw_int
from ..session import pinned, stable
from .ranking import attach, hash_cuts, hash_rank

SPLIT_SEED = "split"


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Row number by file partition. Use right after a file scan, where it is repeatable."""
    return df.withColumn(out, F.monotonically_increasing_id())


def split_by_share(
    df: DataFrame,
    share: float,
    key: Sequence[str],
    groups: Sequence[str] = ("client",),
    seed=SPLIT_SEED,
    out: str = "is_test",
) -> DataFrame:
    """Mark exactly ``ceil(n * share)`` rows of every group as test rows.

    A row is a test row if its key hash is not above the group's exact cut, so
    the rows themselves are neither shuffled nor sorted. Copies of a key that
    straddle the cut, and only they, are stored and told apart by a row number.
    """
    groups = list(groups)
    h = digest(seed, *key)
    size = F.ceil(F.col("n").cast("double") * F.lit(float(share)))
    cuts = hash_cuts(df, h, size, groups)
    straddling = cuts.where(F.col("need") < F.col("ties"))
    if straddling.isEmpty():
        return attach(df, cuts.select(*groups, "cut"), groups).withColumn(out, h <= F.col("cut")).drop("cut")
    marked = attach(df, cuts.select(*groups, "cut", "need"), groups)
    ties = stable(marked.where(h == F.col("cut")).withColumn("_copy", F.monotonically_increasing_id()))
    second = F.md5(F.col("_copy").cast("string").cast("binary"))
    inner = hash_cuts(ties, second, F.col("need"), [*groups, "need"]).select(
        *groups, F.col("cut").alias("_inner")
    )
    told = attach(ties, inner, groups).withColumn(out, second <= F.col("_inner"))
    rest = marked.where(h != F.col("cut")).withColumn(out, h < F.col("cut"))
    return rest.drop("cut", "need").unionByName(told.drop("cut", "need", "_copy", "_inner"))


def train_test(df: DataFrame, share: float, key: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``split_by_share`` without the marker."""
    marked = split_by_share(df, share, key, **options)
    return (
        marked.where(~F.col("is_test")).drop("is_test"),
        marked.where(F.col("is_test")).drop("is_test"),
    )


def shuffle_rows(
    df: DataFrame, key: Sequence[str], groups: Sequence[str] = ("client",), seed="shuffle", epoch: int = 0,
    out: str = "row_idx",
) -> DataFrame:
    """Random order of each group as a new 0-based ``row_idx``; another one per epoch."""
    return hash_rank(df, digest(seed, F.lit(str(epoch)), *key), groups, out)


def mini_batches(df: DataFrame, batch_size: int = 32, row_idx: str = "row_idx", out: str = "batch_id") -> DataFrame:
    """Batch number of each row; the last batch of a group may be short."""
    return df.withColumn(out, F.floor(F.col(row_idx) / F.lit(batch_size)).cast("bigint"))


def mean_holdout_size(holdouts: DataFrame, group: str = "client") -> DataFrame:
    """Whole-number mean of the groups' sizes."""
    return holdouts.agg(
        F.floor(F.try_divide(F.count("*"), F.countDistinct(group))).cast("bigint").alias("mean_size")
    )


def mixture_sample(
    holdouts: DataFrame, size: int, key: Sequence[str], group: str = "client", seed="mix"
) -> DataFrame:
    """``size`` rows with replacement: a group uniformly, then one of its rows uniformly.

    Every slot is one row of ``range(size)`` and finds its row by an equi-join
    on (group, row number); slots and rows are both spread by that key.
    """
    ranked = hash_rank(holdouts, digest(seed, *key), [group], out="row_idx")
    sizes = pinned(holdouts.groupBy(group).agg(F.count("*").alias("group_size")))
    n_groups = sizes.count()
    sizes = sizes.withColumn("_pos", (F.row_number().over(Window.orderBy(group)) - 1).cast("bigint"))
    slots = (
        holdouts.sparkSession.range(size)
        .withColumnRenamed("id", "slot")
        .withColumn("_pos", draw_int(digest(f"{seed}-group", "slot")) % F.lit(n_groups))
        .join(pinned(sizes), "_pos")
        .withColumn("row_idx", draw_int(digest(f"{seed}-row", "slot")) % F.col("group_size"))
        .select("slot", group, "row_idx")
    )
    return attach(slots, ranked, [group, "row_idx"])
