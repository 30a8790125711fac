"""Packs token pieces of documents into sequences by vector best-fit.

Documents are tokenized and cut side by side; pieces (not their texts) are dealt
evenly into groups of bounded size, and each group is packed by itself. Inside a
group the pieces come in falling length; each goes to the open sequence that has
room in every capacity (tokens, documents, attention cost) and scores best, by
the weighted norm of what would be left or by the weighted dot product of piece
and room.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from .tables import as_strings, rows_of
from .tokens import encoder

_ROWS = 2_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how a piece chooses among those with room."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024            # sum of squared piece lengths
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"                      # norm: least weighted residual; dot: largest weighted dot product
    group: int = 8_192                      # pieces packed together


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("deal", T.LongType()),
])


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: all of ``size``, the first may be shorter."""
    first = total % size or size
    return [(0, min(first, total))] + [(s, size) for s in range(first, total, size)] if total else []


def pieces(
    docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int | None = 2,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, deal, and ``ids`` on request.

    ``end_id`` closes every document, so NULL and empty texts give one piece of
    one id. Repeated rows give their pieces again. ``deal`` numbers the pieces of
    a partition from a start that is a hash of the partition's number.
    """
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else PIECES
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
    size = capacity.tokens

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, deal = encoder(tokenizer), first_deal(TaskContext.get().partitionId())
        for batch in rows_of(batches, _ROWS):
            out: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), as_strings(batch.column(1))):
                ids = encode(value or "") + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    row = (doc, k, start, length, crc32(part), deal)
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                    deal += 1
            columns = list(zip(*out)) or [()] * len(schema.fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.fieldNames())

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.dataType.simpleString()] for f in schema.fields]
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(split, schema)


def first_deal(partition: int) -> int:
    """Start of a partition's numbers, spread evenly over 56 bits."""
    return int.from_bytes(blake2b(b"%d" % partition, digest_size=7).digest(), "little")


def best_fit(lengths: Sequence[int], capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths fall or stay equal from piece to piece."""
    room = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights, float)
    n = len(lengths)
    left, bins, offsets = np.empty((n, 3)), np.empty(n, np.int64), np.empty(n, np.int64)
    open_bins, n_open, n_bins = np.empty(n, np.int64), 0, 0
    least = min(lengths) if n else 0
    floor = np.array([least, 1, least * least]) / room - 1e-12
    for at, length in enumerate(lengths):
        need = np.array([length, 1, length * length]) / room
        if np.any(need > 1 + 1e-12):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        chosen = -1
        if n_open and length < capacity.tokens:
            free = left[:n_open]
            fits = np.flatnonzero((free >= need - 1e-12).all(axis=1))
            if len(fits):
                if capacity.rule == "norm":
                    score = ((free[fits] - need) ** 2) @ weight
                else:
                    score = -(free[fits] @ (weight * need))
                chosen = int(fits[score.argmin()])
        if chosen < 0:
            chosen, n_open = n_open, n_open + 1
            left[chosen], open_bins[chosen] = 1.0, n_bins
            n_bins += 1
        bins[at] = open_bins[chosen]
        offsets[at] = round((1 - left[chosen, 0]) * capacity.tokens)
        left[chosen] -= need
        if (left[chosen] < floor).any():     # nothing that is still to come fits in
            n_open -= 1
            left[chosen], open_bins[chosen] = left[n_open], open_bins[n_open]
    return bins, offsets


def pack(cuts: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces with sequence_id and offset. ``cuts`` must be stored, as ``deal`` places its rows.

    Pieces are dealt out one by one from a start that is random per partition,
    so groups differ like draws of about ``capacity.group`` pieces, whatever the
    documents' ids. A task packs several groups, one after the other, where there
    are more than shuffle partitions. Equal lengths are taken in order of
    doc_id (NULL first), piece and deal.
    """
    n_groups = max(1, -(-cuts.count() // capacity.group))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if "ids" in cuts.columns else [])]
    fields = [cuts.schema[c] for c in kept]
    schema = T.StructType([
        *fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["length", "doc_id", "piece", "deal"], ascending=[False, True, True, True], na_position="first")
        bins, offsets = best_fit(rows["length"].tolist(), capacity)
        rows["sequence_id"] = (int(rows["lot"].iloc[0]) << 32) + bins
        rows["offset"] = offsets
        return rows[[*kept, "sequence_id", "offset"]]

    spark = cuts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = cuts.withColumn("lot", F.pmod("deal", F.lit(n_groups)))
    return dealt.repartition(min(n_groups, tasks), "lot").groupBy("lot").applyInPandas(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int | None = 2,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row per piece of each row.

    NULL and empty texts are the end id alone; NULL doc_ids stay NULL; repeated
    rows are packed each; an empty table gives no rows. Other columns are not read.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids)), capacity)
