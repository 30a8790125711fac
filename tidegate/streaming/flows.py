"""Flow streams: source, cleaning and scoring, windowed alerts, attack sessions, sinks.

Every operator takes and returns a DataFrame and works on a stream and on a
table alike; only ``open_stream``, ``write_parquet`` and ``upsert`` are
streaming ends.
"""

from __future__ import annotations

import time as clock
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.cleaning import repair_infinities
from ..operators.networks import Layout, score
from ..operators.scaling import scale

# Tolerated lateness, alert window and session gap.
LATENESS = "10 minutes"
ALERT_WINDOW = "5 minutes"
SESSION_GAP = "30 minutes"

MERGE_SESSIONS = "spark.sql.sessionWindow.merge.sessions.in.local.partition"
STATE_PARTITIONS = "spark.sql.shuffle.partitions"


def open_stream(
    spark: SparkSession, path: str, schema: T.StructType, source: str = "parquet", glob: str | None = None,
    files_per_batch: int | None = None, time: str = "ts", **options,
) -> DataFrame:
    """Stream of flow files; the event time is cast to TIMESTAMP, which watermarks need."""
    reader = spark.readStream.schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(source).load(path).withColumn(time, F.col(time).cast("timestamp"))


def clean_and_score(
    flows: DataFrame, features: Sequence[str], stats: DataFrame, layout: Layout, flat: Sequence[float],
    groups: Sequence[str] = ("client",),
) -> DataFrame:
    """Repair, scale with stored statistics and score; stateless, the same on streams and tables."""
    repaired = repair_infinities(flows, features)
    return score(scale(repaired, stats, features, groups), layout, flat, list(features))


def drop_repeats(flows: DataFrame, key: Sequence[str], time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Drop repeated flows that arrive within the tolerated lateness of each other."""
    return flows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))


def window_counts(
    flows: DataFrame, malicious: str, time: str = "ts", window: str = ALERT_WINDOW, slide: str | None = None,
    lateness: str | None = LATENESS, group: str = "client",
) -> DataFrame:
    """Flows and malicious flows per client and tumbling (or sliding) window."""
    source = flows.withWatermark(time, lateness) if lateness else flows
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        source.groupBy(span.alias("span"), group)
        .agg(F.count("*").alias("flows"), F.sum(F.col(malicious).cast("bigint")).alias("malicious"))
        .select(
            F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), group, "flows",
            "malicious", F.try_divide(F.col("malicious").cast("double"), F.col("flows")).alias("share"),
        )
    )


def alerts(counts: DataFrame, min_malicious: int = 1, min_share: float = 0.0) -> DataFrame:
    """Windows whose count and share of malicious flows reach both thresholds."""
    return counts.where((F.col("malicious") >= min_malicious) & (F.col("share") >= min_share))


def attack_sessions(
    flows: DataFrame, malicious: str, source: str, time: str = "ts", gap: str = SESSION_GAP,
    lateness: str | None = LATENESS,
) -> DataFrame:
    """Runs of malicious flows of one source with no pause of ``gap`` or more.

    Partial sessions are merged before the shuffle, so a source that sends a
    third of all flows reaches its reducer as a few of them. Starting a stream
    turns that on for its query; for a table it is turned on in the session.
    """
    if not flows.isStreaming:
        flows.sparkSession.conf.set(MERGE_SESSIONS, "true")
    attack = flows.where(F.col(malicious))
    if lateness:
        attack = attack.withWatermark(time, lateness)
    return (
        attack.groupBy(F.session_window(time, gap).alias("span"), source)
        .agg(F.count("*").alias("flows"))
        .select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), source, "flows")
    )


def _start(df: DataFrame, checkpoint: str, partitions: int | None, configure) -> StreamingQuery:
    """Start with partial session merging and the wanted number of state partitions.

    The running query keeps the settings it started with; the session gets its own back.
    """
    conf = df.sparkSession.conf
    late_rows(df.sparkSession)
    wanted = {MERGE_SESSIONS: "true"}
    if partitions:
        wanted[STATE_PARTITIONS] = str(partitions)
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        return configure(df.writeStream.option("checkpointLocation", checkpoint)).start()
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def write_parquet(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "1 minute", partitions: int | None = None
) -> StreamingQuery:
    """Append to Parquet, exactly once; ``once`` takes what is there and stops.

    ``partitions`` of the state are fixed by the first start; adaptive execution does not change them.
    """
    def configure(writer):
        writer = writer.format("parquet").outputMode("append").option("path", path)
        return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)

    return _start(df, checkpoint, partitions, configure)


def upsert(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "1 minute", partitions: int | None = None
) -> StreamingQuery:
    """Updated rows per micro-batch, each batch in its own folder; a repeated batch replaces itself.

    ``latest`` reads the newest row per key, ``compact`` merges what has gathered.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={2 * number}")

    def configure(writer):
        writer = writer.outputMode("update").foreachBatch(save)
        return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)

    return _start(df, checkpoint, partitions, configure)


def latest(spark: SparkSession, path: str, key: Sequence[str] = ("window_start", "client")) -> DataFrame:
    """Newest version of every row an ``upsert`` wrote."""
    stored = spark.read.parquet(path)
    fields = [c for c in stored.columns if c not in (*key, "batch")]
    newest = stored.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("_row"))
    return newest.select(*key, "_row.*")


def compact(spark: SparkSession, path: str, key: Sequence[str] = ("window_start", "client")) -> int:
    """Merge the folders of an ``upsert`` into one with the newest row per key; returns the folders removed.

    The merged folder gets the odd number after the last batch, which no batch
    has. Older folders go once it is written, so a failure on the way loses
    nothing and a reader at any time finds the same newest rows. Run it between
    micro-batches or while the query stands still.
    """
    numbers = [r["batch"] for r in spark.read.parquet(path).select("batch").distinct().orderBy("batch").collect()]
    if len(numbers) < 2:
        return 0
    merged = numbers[-1] | 1
    if merged == numbers[-1]:       # merged before, its older folders are still there
        numbers = numbers[:-1]
    else:
        latest(spark, path, key).write.mode("overwrite").parquet(f"{path}/batch={merged}")
    store, base = fs.FileSystem.from_uri(path)
    for number in numbers:
        store.delete_dir(f"{base}/batch={number}")
    return len(numbers)


class LateRows(StreamingQueryListener):
    """Adds up, over all batches of every query, the rows that came after the watermark."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batch: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress, query = event.progress, str(event.progress.runId)
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        self.dropped[query] = self.dropped.get(query, 0) + late
        self.batch[query] = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(spark: SparkSession) -> LateRows:
    """The session's counter, listening from the first call on."""
    counter = getattr(spark, "_late_rows", None)
    if counter is None:
        counter = spark._late_rows = LateRows()
        spark.streams.addListener(counter)
    return counter


def dropped_late_rows(query: StreamingQuery, spark: SparkSession, patience: float = 10.0) -> int:
    """Rows the query's stateful operators dropped as later than the watermark, over all its batches.

    Counts arrive a moment after a batch; the last batch's are waited for.
    """
    counter, run, last = late_rows(spark), str(query.runId), query.lastProgress
    until = clock.monotonic() + patience
    while last and counter.batch.get(run, -1) < last["batchId"] and clock.monotonic() < until:
        clock.sleep(0.05)
    return counter.dropped.get(run, 0)
