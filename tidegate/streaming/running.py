"""Attack sessions while they run: reported when they open, when they grow and when they close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .flows import LATENESS, SESSION_GAP

OPEN, CLOSED, MERGED = "open", "closed", "merged"

Session = tuple[int, int, int]          # first and last flow in microseconds, number of flows

STATE = "firsts array<bigint>, lasts array<bigint>, flows array<bigint>"


def join_sessions(known: list[Session], parts: list[Session], gap: int) -> tuple[list[Session], list[int], list[int]]:
    """Known and new sessions merged where less than ``gap`` lies between them.

    Returns the sessions in order of time, the starts of those that are new or
    have changed, and the starts of known ones that went into an earlier one.
    """
    merged: list[list[int]] = []
    changed: set[int] = set()
    for first, last, flows, fresh in sorted([(*s, False) for s in known] + [(*s, True) for s in parts]):
        if merged and first < merged[-1][1] + gap:
            into = merged[-1]
            into[1], into[2] = max(into[1], last), into[2] + flows
            changed.add(into[0])
        else:
            merged.append([first, last, flows])
            if fresh:
                changed.add(first)
    starts = {s[0] for s in merged}
    gone = sorted({s[0] for s in known} - starts)
    return [tuple(s) for s in merged], sorted(changed), gone


def _partial_sessions(source: str, gap: int):
    """Rows of one Arrow batch to its sessions: a hot source leaves the task as a few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who = batch.column(source)
            codes = who.dictionary_encode(null_encoding="encode").indices.to_numpy()
            at = batch.column("_at").to_numpy()
            order = np.lexsort((at, codes))
            codes, at = codes[order], at[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (codes[1:] != codes[:-1]) | (at[1:] - at[:-1] >= gap)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(at))
            yield pa.RecordBatch.from_arrays(
                [who.take(pa.array(order[starts])), pa.array(at[starts]), pa.array(at[ends - 1]),
                 pa.array((ends - starts).astype("int64"))],
                names=[source, "first", "last", "flows"],
            )

    return run


def _track(source: str, gap: int):
    """One source's sessions over the micro-batches; open ones are the state, the next end is its timer."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(zip(*state.get)) if state.exists else []
        mark = state.getCurrentWatermarkMs()
        sessions, changed, gone = known, [], []
        if not state.hasTimedOut:
            new = [s for p in parts for s in zip(p["first"].tolist(), p["last"].tolist(), p["flows"].tolist())]
            sessions, changed, gone = join_sessions(known, new, gap)
        still = [s for s in sessions if s[1] + gap > mark * 1000]
        ended = {s[0] for s in sessions} - {s[0] for s in still}
        told = [(*s, CLOSED if s[0] in ended else OPEN) for s in sessions if s[0] in ended or s[0] in set(changed)]
        told += [(start, start - gap, 0, MERGED) for start in gone]
        if still:
            state.update(tuple(list(column) for column in zip(*still)))
            # a timer fires once the watermark has passed it: a millisecond before the first end
            end = min(s[1] for s in still) + gap
            state.setTimeoutTimestamp(max(-(-end // 1000) - 1, mark + 1))
        elif state.exists:
            state.remove()
        if told:
            first, last, flows, how = zip(*told)
            yield pd.DataFrame({
                source: pd.Series([key[0]] * len(told), dtype=object), "first": first,
                "end": [at + gap for at in last], "flows": flows, "state": how,
            })

    return run


def running_sessions(
    flows: DataFrame, malicious: str, source: str, time: str = "ts", gap: str = SESSION_GAP, lateness: str = LATENESS,
) -> DataFrame:
    """Sessions as ``attack_sessions`` has them, in every micro-batch that opens, extends or closes them.

    Rows (session_start, session_end, ``source``, flows, state) for an ``upsert``
    under the key (``source``, session_start): ``open`` as soon as the first
    malicious flow is read, again whenever it has grown, ``closed`` once the
    watermark has passed its end, and ``merged`` with 0 flows where a flow that
    came late joined it to an earlier one, which holds its flows from then on.

    Tasks merge their rows into partial sessions before the shuffle. A partial
    session is late, and left out, if its last flow is behind the watermark.
    Rows without a time are left out; those without a source are one source. A
    stream only; the state holds a source's open sessions.
    """
    span = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    kind = flows.schema[source].dataType
    parts_schema = T.StructType([
        T.StructField(source, kind), *[T.StructField(name, T.LongType()) for name in ("first", "last", "flows")]
    ])
    told_schema = T.StructType([
        T.StructField(source, kind), *[T.StructField(name, T.LongType()) for name in ("first", "end", "flows")],
        T.StructField("state", T.StringType()),
    ])
    parts = (
        flows.where(F.col(malicious) & F.col(time).isNotNull())
        .select(source, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
        .mapInArrow(_partial_sessions(source, span), parts_schema)
        .withColumn("_seen", F.timestamp_micros("last")).withWatermark("_seen", lateness)
    )
    told = parts.groupBy(source).applyInPandasWithState(
        _track(source, span), told_schema, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    return told.select(
        F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("end").alias("session_end"),
        source, "flows", "state",
    )
