"""Streams over the events and flow files.

Every query runs its stream to the end of the available files. Windows and
sessions appear once the watermark has passed their end; the SQL twins apply
the same rule to the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import scaling
from ..operators.networks import initial_parameters
from ..session import scratch_path
from ..streaming import flows as stream
from ..streaming.running import running_sessions
from .model_queries import SMALL
from .network_sql import network_sql
from .registry import register
from .views import EVENTS_SQL, FEATURES, FLOWS_SQL, as_stream_rows, flows, flows_from, table

# As text, so that the result does not depend on the session's time zone.
CLOCK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CLOCK_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _clock(name):
    return F.date_format(name, CLOCK).alias(name)


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return as_stream_rows(stream.open_stream(spark, sf_dir, schema, glob="events.parquet"))


def _cores(spark) -> int:
    return spark.sparkContext.defaultParallelism


def _finished(spark, rows: DataFrame) -> DataFrame:
    """Run to the end of the input into Parquet and read it back."""
    path = scratch_path(spark, "stream-out")
    schema = rows.schema
    query = stream.write_parquet(rows, path, scratch_path(spark, "stream-state"), partitions=_cores(spark))
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


@register("o57_flow_stream", "WITH " + EVENTS_SQL + """
SELECT client, malicious, count(*) AS n, round(sum(value), 4) AS value FROM flow_events GROUP BY ALL""")
def flow_stream(spark, sf_dir):
    rows = _finished(spark, _event_stream(spark, sf_dir))
    return rows.groupBy("client", "malicious").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@register("o58_stream_scoring", "WITH " + FLOWS_SQL + f""",
stats AS (SELECT client, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)} FROM flows GROUP BY client),
prepared AS (SELECT client, flow_key, attack, [{", ".join(f"(t.{c} - m_{c}) / s_{c}" for c in FEATURES)}] AS x FROM flows t JOIN stats USING (client)),
""" + network_sql(SMALL, "stream", "prepared", "flow_key", "scored") + """
SELECT client, CASE WHEN scores[2] > scores[1] THEN 1 ELSE 0 END::BIGINT AS pred, count(*) AS n, round(sum(list_max(scores)), 3) AS top
FROM scored JOIN prepared USING (flow_key) GROUP BY ALL""")
def stream_scoring(spark, sf_dir):
    """Flow files as a stream, scaled with stored statistics and scored by the batch functions."""
    stats = scaling.fit_standard(flows(spark, sf_dir), FEATURES)
    schema = table(spark, sf_dir, "lineitem").schema
    raw = stream.open_stream(spark, sf_dir, schema, glob="lineitem.parquet", time="l_shipdate")
    scored = stream.clean_and_score(
        flows_from(raw).select("client", *FEATURES), FEATURES, stats, SMALL, initial_parameters(SMALL, "stream")
    )
    rows = _finished(spark, scored.select("client", "pred", F.array_max("scores").alias("top")))
    return rows.groupBy("client", "pred").agg(F.count("*").alias("n"), F.round(F.sum("top"), 3).alias("top"))


def _windows_sql(width: str, slide: str | None = None) -> str:
    starts = (
        f"time_bucket(INTERVAL '{width}', ts)" if slide is None
        else f"time_bucket(INTERVAL '{slide}', ts) - k * INTERVAL '{slide}'"
    )
    offsets = "" if slide is None else ", range(0, 2) o(k)"
    return f"""WITH {EVENTS_SQL},
closed AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM flow_events),
counts AS (SELECT {starts} AS window_start, client, count(*) AS flows, sum(CAST(malicious AS BIGINT)) AS malicious
           FROM flow_events{offsets} GROUP BY ALL)
SELECT {CLOCK_SQL.format("window_start")} AS window_start, {CLOCK_SQL.format(f"window_start + INTERVAL '{width}'")} AS window_end,
       client, flows, CAST(malicious AS BIGINT) AS malicious, round(malicious / flows, 6) AS share
FROM counts, closed WHERE window_start + INTERVAL '{width}' <= mark"""


def _window_rows(rows):
    return rows.select(
        _clock("window_start"), _clock("window_end"), "client", "flows", "malicious", F.round("share", 6).alias("share")
    )


@register("o59_window_alerts", _windows_sql("1 hour") + " AND malicious >= 2 AND malicious / flows >= 0.25")
def window_alerts(spark, sf_dir):
    counts = stream.window_counts(_event_stream(spark, sf_dir), "malicious", window="1 hour")
    return _window_rows(_finished(spark, stream.alerts(counts, 2, 0.25)))


@register("o59_sliding_windows", _windows_sql("1 hour", "30 minutes"))
def sliding_windows(spark, sf_dir):
    counts = stream.window_counts(_event_stream(spark, sf_dir), "malicious", window="1 hour", slide="30 minutes")
    return _window_rows(_finished(spark, counts))


@register("o60_attack_sessions", "WITH " + EVENTS_SQL + f""",
attack AS (SELECT client, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY client ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh
           FROM flow_events WHERE malicious),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts) AS run FROM attack),
sessions AS (SELECT client, run, min(ts) AS first, max(ts) + INTERVAL '30 minutes' AS last, count(*) AS flows FROM runs GROUP BY ALL)
SELECT client, {CLOCK_SQL.format("first")} AS session_start, {CLOCK_SQL.format("last")} AS session_end, flows
FROM sessions WHERE last <= (SELECT max(ts) - INTERVAL '10 minutes' FROM attack)""")
def attack_sessions(spark, sf_dir):
    sessions = _finished(spark, stream.attack_sessions(_event_stream(spark, sf_dir), "malicious", "client"))
    return sessions.select("client", _clock("session_start"), _clock("session_end"), "flows")


@register("o60_attack_sessions_table", "WITH " + EVENTS_SQL + """,
attack AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh
           FROM flow_events WHERE malicious),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts) AS run FROM attack),
sessions AS (SELECT source, run, count(*) AS flows FROM runs GROUP BY ALL)
SELECT source, count(*) AS sessions, CAST(sum(flows) AS BIGINT) AS flows, max(flows) AS longest FROM sessions GROUP BY source""")
def attack_sessions_table(spark, sf_dir):
    """The same operator on a table, per source, with a two-hour gap."""
    rows = as_stream_rows(table(spark, sf_dir, "events"))
    sessions = stream.attack_sessions(rows, "malicious", "source", gap="2 hours", lateness=None)
    return sessions.groupBy("source").agg(
        F.count("*").alias("sessions"), F.sum("flows").alias("flows"), F.max("flows").alias("longest")
    )


@register("o60_running_sessions", "WITH " + EVENTS_SQL + f""",
attack AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh
           FROM flow_events WHERE malicious),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts) AS run FROM attack),
sessions AS (SELECT source, run, min(ts) AS first, max(ts) + INTERVAL '2 hours' AS last, count(*) AS flows,
                    count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS early FROM runs GROUP BY ALL)
SELECT source, {CLOCK_SQL.format("first")} AS session_start, {CLOCK_SQL.format("last")} AS session_end, flows,
       CASE WHEN early > 0 THEN early ELSE flows END AS first_flows,
       CASE WHEN last <= (SELECT max(ts) - INTERVAL '10 minutes' FROM attack) THEN 'closed' ELSE 'open' END AS state
FROM sessions""")
def running(spark, sf_dir):
    """The two halves of the month arrive one after the other; the flows of a session at its first report and at the end."""
    folder, out, state = (scratch_path(spark, name) for name in ("running-in", "running-out", "running-state"))
    e = table(spark, sf_dir, "events")
    for part in (F.col("ts") < "2024-01-16", F.col("ts") >= "2024-01-16"):
        e.where(part).write.mode("append").parquet(folder)
        rows = as_stream_rows(stream.open_stream(spark, folder, e.schema))
        told = running_sessions(rows, "malicious", "source", gap="2 hours")
        stream.upsert(told, out, state, partitions=_cores(spark)).awaitTermination()
    key = ["source", "session_start"]
    first = spark.read.parquet(out).groupBy(*key).agg(F.min_by("flows", "batch").alias("first_flows"))
    newest = stream.latest(spark, out, key).join(first, key)
    return newest.select("source", _clock("session_start"), _clock("session_end"), "flows", "first_flows", "state")


@register("o61_duplicate_flows", "WITH " + EVENTS_SQL + """
SELECT client, count(*) AS n, count(DISTINCT event_id) AS keys, round(sum(value), 4) AS value FROM flow_events GROUP BY client""")
def duplicate_flows(spark, sf_dir):
    """Every event arrives twice; one of each is kept."""
    rows = _event_stream(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    kept = _finished(spark, stream.drop_repeats(twice, ["event_id"]))
    return kept.groupBy("client").agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("keys"), F.round(F.sum("value"), 4).alias("value")
    )


@register("o61_late_flows", "WITH " + EVENTS_SQL + f""",
timely AS (SELECT * FROM flow_events WHERE ts >= TIMESTAMP '2024-01-16'),
counts AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, client, count(*) AS flows FROM timely GROUP BY ALL)
SELECT {CLOCK_SQL.format("window_start")} AS window_start, client, flows FROM counts
WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM timely)""")
def late_flows(spark, sf_dir):
    """The second half of the month arrives first; the first half comes too late and is left out."""
    folder, out, state = (scratch_path(spark, name) for name in ("late-in", "late-out", "late-state"))
    e = table(spark, sf_dir, "events")
    for part in (F.col("ts") >= "2024-01-16", F.col("ts") < "2024-01-16"):
        e.where(part).write.mode("append").parquet(folder)
        rows = as_stream_rows(stream.open_stream(spark, folder, e.schema))
        counts = stream.window_counts(rows, "malicious", window="1 hour")
        stream.write_parquet(counts, out, state, partitions=_cores(spark)).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).select(_clock("window_start"), "client", "flows")


@register("o62_alert_upsert", "WITH " + EVENTS_SQL + f"""
SELECT {CLOCK_SQL.format("time_bucket(INTERVAL '1 hour', ts)")} AS window_start, client, count(*) AS flows,
       CAST(sum(CAST(malicious AS BIGINT)) AS BIGINT) AS malicious
FROM flow_events GROUP BY ALL""")
def alert_upsert(spark, sf_dir):
    """Running counts per window, upserted by batch; open windows are there too."""
    path = scratch_path(spark, "alerts")
    counts = stream.window_counts(_event_stream(spark, sf_dir), "malicious", window="1 hour")
    stream.upsert(counts, path, scratch_path(spark, "alert-state"), partitions=_cores(spark)).awaitTermination()
    return stream.latest(spark, path).select(_clock("window_start"), "client", "flows", "malicious")
