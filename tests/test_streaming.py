import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.streaming import flows as st

from conftest import rows

SCHEMA = "event_id bigint, ts timestamp, client int, malicious boolean"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drop_file(spark, folder, name, events):
    df = spark.createDataFrame([(i, at(m), c, bad) for i, m, c, bad in events], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(str(folder))
    assert name


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")


def source(spark, folder, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return st.open_stream(spark, str(folder), schema, **options)


def finish(query):
    query.awaitTermination()
    return query


def test_closed_windows_equal_the_table(spark, folders):
    folder, out, state = folders
    drop_file(spark, folder, "a", [(i, i * 1.5, i % 2, i % 3 == 0) for i in range(100)])
    counts = st.window_counts(source(spark, folder), "malicious")
    finish(st.write_parquet(counts, out, state))
    got = spark.read.parquet(out)
    table = st.window_counts(spark.read.parquet(str(folder)), "malicious", lateness=None)
    mark = at(99 * 1.5 - 10)
    assert rows(got) == rows(table.where(F.col("window_end") <= F.lit(mark)))
    assert got.count() > 20
    alerts = st.alerts(table, min_malicious=1, min_share=0.5)
    assert alerts.where("share < 0.5 or malicious < 1").isEmpty()


def test_late_rows_are_dropped_and_counted(spark, folders):
    folder, out, state = folders
    drop_file(spark, folder, "a", [(1, 0, 1, True), (2, 60, 1, True)])
    counts = st.window_counts(source(spark, folder), "malicious")
    finish(st.write_parquet(counts, out, state))
    drop_file(spark, folder, "b", [(3, 1, 1, True), (4, 120, 1, False)])       # 3 is an hour late
    query = finish(st.write_parquet(counts, out, state))
    assert st.dropped_late_rows(query, spark) == 1
    got = {r["window_start"]: r["flows"] for r in spark.read.parquet(out).collect()}
    assert got == {at(0): 1, at(60): 1}


def test_restart_repeats_nothing(spark, folders):
    folder, out, state = folders
    rows_in = source(spark, folder)
    drop_file(spark, folder, "a", [(i, i, 1, False) for i in range(10)])
    finish(st.write_parquet(rows_in, out, state))
    finish(st.write_parquet(rows_in, out, state))
    drop_file(spark, folder, "b", [(i, i, 1, False) for i in range(10, 15)])
    finish(st.write_parquet(rows_in, out, state))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_duplicates_within_the_watermark(spark, folders):
    folder, out, state = folders
    drop_file(spark, folder, "a", [(1, 0, 1, True), (1, 0, 1, True), (2, 1, 1, True)])
    kept = st.drop_repeats(source(spark, folder), ["event_id"])
    finish(st.write_parquet(kept, out, state))
    drop_file(spark, folder, "b", [(2, 2, 1, True), (3, 3, 1, True)])
    finish(st.write_parquet(kept, out, state))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_sessions_of_a_hot_source(spark, folders):
    """One source sends most rows over many files; its sessions equal those of the table."""
    folder, out, state = folders
    for part in range(4):
        events = [(part * 100 + i, (part * 100 + i) * 7 + (60 if i >= 50 else 0), 1, True) for i in range(100)]
        drop_file(spark, folder, part or "0", events + [(1000 + part, part * 700, 2, True)])
    drop_file(spark, folder, "end", [(5000, 10_000, 3, True)])
    sessions = st.attack_sessions(source(spark, folder), "malicious", "client")
    finish(st.write_parquet(sessions, out, state))
    table = st.attack_sessions(spark.read.parquet(str(folder)), "malicious", "client", lateness=None)
    want = table.where(F.col("session_end") <= F.lit(at(10_000 - 10)))
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() > 3


def test_session_merging_is_on_while_starting_only(spark, folders):
    folder, out, state = folders
    before = spark.conf.get(st.MERGE_SESSIONS)
    spark.conf.set(st.MERGE_SESSIONS, "false")
    try:
        drop_file(spark, folder, "a", [(1, 0, 1, True), (2, 100, 1, True)])
        sessions = st.attack_sessions(source(spark, folder), "malicious", "client")
        query = finish(st.write_parquet(sessions, out, state))
        assert query.lastProgress is not None and spark.conf.get(st.MERGE_SESSIONS) == "false"
    finally:
        spark.conf.set(st.MERGE_SESSIONS, before)


def test_upsert_keeps_the_newest_count(spark, folders):
    folder, out, state = folders
    counts = st.window_counts(source(spark, folder), "malicious", window="1 hour")
    drop_file(spark, folder, "a", [(1, 0, 1, True), (2, 5, 1, False)])
    finish(st.upsert(counts, out, state))
    drop_file(spark, folder, "b", [(3, 6, 1, True)])
    finish(st.upsert(counts, out, state))
    got = st.latest(spark, out).collect()
    assert [(r["client"], r["flows"], r["malicious"]) for r in got] == [(1, 3, 2)]
    assert st.compact(spark, out) == 2 and st.compact(spark, out) == 0
    assert rows(st.latest(spark, out).select("client", "flows", "malicious")) == [(1, 3, 2)]
    drop_file(spark, folder, "c", [(4, 7, 1, False), (5, 8, 2, True)])
    finish(st.upsert(counts, out, state))
    assert rows(st.latest(spark, out).select("client", "flows", "malicious")) == [(1, 4, 2), (2, 1, 1)]
    assert st.compact(spark, out) == 2
    assert rows(st.latest(spark, out).select("client", "flows", "malicious")) == [(1, 4, 2), (2, 1, 1)]
