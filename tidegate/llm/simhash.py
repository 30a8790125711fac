"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles. Distinct fingerprints are cut into segments; two of them that differ
in at most ``distance`` bits agree in some segment up to ``distance // segments``
bits, so each enumerates that Hamming ball in every segment, meets the stored
segments of the others in a join, and the join condition checks all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import written
from .components import components
from .tables import as_strings, fresh, rows_of

BITS = 64
SHINGLE_WORDS = 3
DISTANCE = 3
SEGMENTS = 2
CROWDED = 256            # stored segments with more fingerprints than this are told apart by a further byte
_ROWS, _SHINGLES = 2_000, 32_768


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words or NULL.

    Only A-Z are lower-cased, words are runs of other characters than space and
    code points 9 to 13. A text with fewer words than a shingle is one shingle.
    """
    if text is None:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _SHINGLES):
        part = hashes[at:at + _SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        ones += np.ones(len(bits), np.float32).dot(bits.astype(np.float32)).astype(np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``out``, the fingerprint as a signed BIGINT."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, _ROWS):
            marks = (fingerprint(t, words) for t in as_strings(batch.column(names.index(text))))
            signed = np.fromiter(marks, np.uint64, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed)], names=[*names, out])

    names = docs.columns
    return docs.mapInArrow(sign, schema)


def hex_fingerprint(column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one bit at most."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(column: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << width) - 1))


def _half_ball(mark: Column, segment: int, span: tuple[int, int], radius: int) -> Column:
    """Segment values 1 to ``radius`` bits away whose lowest changed bit is 0 here: a pair is met from that side."""
    own = _cut(mark, *span)
    flips = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(span[1]), r)]

    def probe(flip: Column) -> Column:
        return F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(flip).alias("key"), F.lit(True).alias("flipped"))

    usable = F.filter(F.array(*(F.lit(x).cast("bigint") for x in flips)),
                      lambda flip: own.bitwiseAND(flip).bitwiseAND(F.negate(flip)) == 0)
    return F.transform(usable, probe)


def _bytes_outside(mark: Column, segment: Column, spans: list[tuple[int, int]], pieces: int) -> Column:
    """Array of (which, value): the bits outside the segment in ``pieces`` parts, for crowded segments."""
    choices = None
    for k, (first, width) in enumerate(spans):
        rest = [b for b in range(BITS) if not first <= b < first + width]
        cuts = [rest[len(rest) * j // pieces:len(rest) * (j + 1) // pieces] for j in range(pieces)]
        masks = [sum(1 << b for b in cut) for cut in cuts]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        parts = F.array(*(
            F.struct(F.lit(j + 1).alias("piece"), mark.bitwiseAND(F.lit(m).cast("bigint")).alias("rest"))
            for j, m in enumerate(signed)
        ))
        choices = F.when(segment == k, parts) if choices is None else choices.when(segment == k, parts)
    return choices


def links(marks: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``mark`` that differ in 1 to ``distance`` bits; none is lost.

    A stored segment that more than ``crowded`` fingerprints share is refined: a
    pair within ``distance`` bits also agrees fully in one of ``distance + 1``
    parts of its other bits, so both sides are spread over those parts.
    """
    spans, radius = _segments(segments), distance // segments
    mark = F.col("mark")
    stored = marks.select(mark, F.explode(F.array(*(
        F.struct(F.lit(k).alias("segment"), _cut(mark, *span).alias("key")) for k, span in enumerate(spans)
    ))).alias("s")).select(mark, "s.*")
    same = F.array(*(
        F.struct(F.lit(k).alias("segment"), _cut(mark, *span).alias("key"), F.lit(False).alias("flipped"))
        for k, span in enumerate(spans)
    ))
    ball = F.concat(same, *(_half_ball(mark, k, span, radius) for k, span in enumerate(spans) if radius))
    probes = marks.select(mark, F.explode(ball).alias("s")).select(mark, "s.*")

    crowd = written(stored.groupBy("segment", "key").count().where(F.col("count") > crowded).select("segment", "key"))
    keys = ["segment", "key"]
    if not crowd.isEmpty():
        crowd = crowd.withColumn("full", F.lit(True))

        def spread(side: DataFrame) -> DataFrame:
            lone = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("rest")))
            parts = F.when(F.col("full"), _bytes_outside(mark, F.col("segment"), spans, distance + 1)).otherwise(lone)
            return side.join(crowd, ["segment", "key"], "left").withColumn("p", F.explode(parts)).select(
                *side.columns, "p.*")

        stored, probes, keys = spread(stored), spread(probes), [*keys, "piece", "rest"]
    left, right = probes.alias("l"), stored.alias("r")
    apart = F.bit_count(F.col("l.mark").bitwiseXOR(F.col("r.mark")))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    near = (apart >= 1) & (apart <= distance) & (F.col("flipped") | (F.col("l.mark") < F.col("r.mark")))
    condition = near
    for part in on:
        condition = condition & part
    return left.join(right, condition).select(F.col("l.mark").alias("a"), F.col("r.mark").alias("b"))


def groups(signed: DataFrame, mark: str, doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(mark, root, component_id) of every distinct fingerprint in ``signed``; the id is the smallest of its component.

    ``root`` is the component's smallest fingerprint. NULL ids count only where a
    component has no other; its id is then NULL. ``signed`` is read several times
    and should be stored.
    """
    marks = written(signed.groupBy(F.col(mark).alias("mark")).agg(F.min(doc_id).alias("least")))
    roots = components(links(marks.select("mark"), distance))
    rooted = marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select(
        "mark", "least", F.coalesce("root", "mark").alias("root"))
    # stored, so that the join's two sides are plain shuffles and a large component can be split
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(least, "root").select("mark", "root", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Empty, blank and NULL texts have fingerprint 0 and link like any other.
    Repeated rows and repeated ids keep a row each. Other columns are not read.
    An empty table gives an empty result.
    """
    signed = written(with_fingerprint(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "mark", "text", words
    ).select("doc_id", "mark"))
    ids = groups(signed, "mark", "doc_id", distance)
    return signed.join(ids, "mark").select("doc_id", hex_fingerprint("mark").alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component only the row with the smallest id.

    Rows that repeat that id count as copies; of them the one with the smallest
    fingerprint stays, of equal ones that whose text has the smallest hash. A
    component whose ids are all NULL keeps one row too. All columns are kept.
    """
    mark, own, least, copies, tie = fresh(docs, "mark", "own_mark", "least_id", "copies", "tie")
    stored = written(with_fingerprint(docs, mark, text, words))
    ids = groups(stored, mark, doc_id, distance)
    rows = stored.groupBy(F.col(mark).alias("mark"), F.col(doc_id).alias("id")).agg(F.count("*").alias("copies"))
    best = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "copies")
    winners = written(rows.join(ids, "mark").groupBy("root").agg(F.min(best).alias("w")).select(
        F.col("w.mark").alias(own), F.col("w.id").alias(least), F.col("w.copies").alias(copies)))
    same = (F.col(mark) == F.col(own)) & F.col(doc_id).eqNullSafe(F.col(least))
    kept = stored.join(winners.hint("shuffle_hash"), same)
    if winners.where(F.col(copies) > 1).isEmpty():
        return kept.select(*docs.columns)
    repeated = kept.where(F.col(copies) > 1).withColumn(tie, F.xxhash64(text))
    first = repeated.groupBy(F.col(mark).alias("m"), F.col(doc_id).alias("i")).agg(F.min(tie).alias("t"))
    one = (F.col(mark) == F.col("m")) & F.col(doc_id).eqNullSafe(F.col("i")) & (F.col(tie) == F.col("t"))
    repeated = repeated.join(first, one, "left_semi").dropDuplicates([mark, doc_id])
    return kept.where(F.col(copies) == 1).unionByName(repeated.drop(tie)).select(*docs.columns)
