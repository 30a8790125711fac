"""Document fingerprints: bottom-k sketches of word-shingle hashes, as column expressions.

A sketch is the ascending array of the ``k`` smallest distinct XXH64 values of a
text's word shingles. Sketches of parts merge into the sketch of the whole: the
``k`` smallest values of their union. A sketch that holds fewer than ``k``
values is complete. Two sketches are compared below the smaller of their reaches
(the largest value of a full one, no limit for a complete one): there both show
every value they have, so resemblance, containment and counts are unbiased, and
exact where both are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import TEXT_BLANKS, fresh

SIZE = 128               # hashes of a sketch: a standard error of 0.04 at a resemblance of 0.3
SHINGLE_WORDS = 5
FANOUT = 64              # sketches that one group merges
SPLITS_PER_PARTITION = 8
MAX_SPLITS = 4_096
_SAMPLED = 64            # sampled keys per split
_BLANK = "[\\x20\\x09-\\x0D]+"
_LONGS = "array<bigint>"


def sketch(text: Column, size: int = SIZE, words: int = SHINGLE_WORDS) -> Column:
    """Ascending array of the ``size`` smallest hashes of the text's word shingles.

    Words are runs of other characters than space and code points 9 to 13. A text
    with fewer words than a shingle is one shingle; NULL, empty and blank texts
    have none, so their sketch is empty.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(TEXT_BLANKS))
    parts = F.split(trimmed, _BLANK)

    def hashes(w: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*(F.get(w, i + k) for k in range(words)))

        return F.slice(F.sort_array(F.array_distinct(
            F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - words)), at))), 1, size)

    # the words are bound once, by a transform over one element
    bound = F.get(F.transform(F.array(parts), hashes), F.lit(0))
    return F.when(trimmed == "", F.array().cast(_LONGS)).otherwise(bound)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def _below(a: Column, b: Column, size: int) -> tuple[Column, Column, Column]:
    """Both sketches' values up to the smaller reach, and that reach (NULL: both complete)."""
    # a sketch ascends, so its largest value is its last; a complete one has no value at that place
    least = F.least(F.get(a, F.lit(size - 1)), F.get(b, F.lit(size - 1)))

    def cut(s: Column) -> Column:
        return F.when(least.isNull(), s).otherwise(F.filter(s, lambda h: h <= least))

    return cut(a), cut(b), least


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the two texts' distinct shingles that both have; 1 for two texts without any."""
    x, y, _ = _below(a, b, size)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union.cast("double"))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's distinct shingles that b has too; 1 where a shows none below the common reach."""
    x, y, _ = _below(a, b, size)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x).cast("double"))


def distinct_count(s: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``, else (size - 1) over the covered share of all hashes."""
    share = (F.get(s, F.lit(size - 1)).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(s) < size, F.size(s).cast("double")).otherwise(F.lit(size - 1.0) / share)


def as_text(s: Column) -> Column:
    """A sketch as one string, 16 lower-case hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(parts: DataFrame, key: str, part: str, column: str, size: int = SIZE) -> DataFrame:
    """One sketch per key from the sketches of its parts, numbered from 0 in ``part``.

    Merged in rounds of at most ``FANOUT`` neighbours, so a key with very many
    parts is never one group. Repeated part numbers merge as well; NULL sketches
    count as empty, rows without a part number as part 0.
    """
    rows = parts.select(key, F.coalesce(F.col(part).cast("bigint"), F.lit(0)).alias("at"),
                        F.coalesce(F.col(column), F.array().cast(_LONGS)).alias("s"))
    last = rows.agg(F.max("at")).first()[0]
    while True:
        joined = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), 1, size)
        rows = rows.groupBy(key, F.floor(F.col("at") / FANOUT).alias("at")).agg(joined.alias("s"))
        last = (last or 0) // FANOUT
        if last == 0:
            return rows.select(key, F.col("s").alias(column))


def _order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts by doc_id (NULL first), then by the text's hash."""
    def digits(x: Column) -> Column:       # unsigned order of a signed number
        return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")

    return F.concat(F.coalesce(digits(doc_id.cast("bigint")), F.lit("")), F.lit("/"), digits(F.xxhash64(text)))


def _split_keys(keys: DataFrame, splits: int) -> list[str]:
    """The least key and up to ``splits`` keys that cut the table evenly, ascending; read from a bounded sample of
    the rows, by hash. They only say where a block of rows begins; every row is in some block."""
    found = keys.agg(F.count("*").alias("n"), F.min("key").alias("least")).first()
    if not found.n:
        return []
    share = min(1.0, splits * _SAMPLED / found.n)
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(r.key for r in keys.where(drawn).select("key").limit(4 * splits * _SAMPLED).collect())
    return sorted({found.least, *sample[_SAMPLED::_SAMPLED]})


def with_next(docs: DataFrame, out: str, doc_id: str, text: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` and ``out``: the text of the next row by ascending id; after the last row comes the first.

    ``carried`` maps further columns to expressions over the row that holds
    ``out``; of each its own value and, as ``next_<name>``, the next row's is
    added. NULL ids come first, rows with equal ids follow by the hash of their
    texts. Rows are dealt by one shuffle into blocks of neighbours; the row that
    opens a block is sent to the block before as well.
    """
    spark = docs.sparkSession
    key, block, ahead = fresh(docs, "order_key", "block", "ahead")
    rows = docs.withColumn(key, _order_key(F.col(doc_id), F.col(text)))
    splits = min(MAX_SPLITS, SPLITS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _split_keys(rows.select(F.col(key).alias("key")), splits)
    table = F.split(F.lit(",".join(cuts)), ",")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step < len(cuts)) & (F.get(table, at + step) <= F.col(key)), at + step).otherwise(at))
    rows = rows.withColumn(block, found)
    opens = F.get(table, F.col(block)) == F.col(key)
    before = F.pmod(F.col(block) - 1, F.lit(max(1, len(cuts))))
    own = F.struct(F.col(block).alias("block"), F.lit(False).alias("ahead"))
    sent = F.when(opens, F.array(own, F.struct(before.alias("block"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    rows = rows.select(*docs.columns, key, F.inline(sent).alias(block, ahead))
    order = Window.partitionBy(block).orderBy(ahead, key)
    rows = rows.withColumn(out, F.lead(text).over(order))
    if carried:
        rows = rows.withColumns(carried)
        rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where(~F.col(ahead)).drop(key, block, ahead)


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(length / 2) code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, words: int = SHINGLE_WORDS,
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, kept_share.

    One row per row of ``docs``. The edited text ends with the beginning of the
    next document's (see ``edited``, ``with_next``); a single row is its own next
    one. ``near_edited`` and ``near_next`` are resemblances of sketches;
    ``n_shingles`` estimates the text's distinct shingles, ``kept_share`` how much
    of them the edited text contains. NULL texts are empty. Repeated rows keep a
    row each, other columns are not read, an empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(own, "following", "doc_id", "text", {"s": sketch(F.col("text"), size, words)})
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("following")))
    rows = rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edit"), 256).alias("edited_sha256"),
        "s", "next_s", sketch(F.col("edit"), size, words).alias("e"))
    s, e, following = F.col("s"), F.col("e"), F.col("next_s")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(s).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(s, e, size).alias("near_edited"), resemblance(s, following, size).alias("near_next"),
        distinct_count(s, size).alias("n_shingles"), containment(s, e, size).alias("kept_share"))
