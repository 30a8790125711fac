import random

from pyspark.sql import functions as F

from tidegate.streaming import flows as st
from tidegate.streaming.running import join_sessions, running_sessions

from conftest import rows
from test_streaming import at, drop_file, finish, folders, source  # noqa: F401

KEY = ("client", "session_start")


def step(spark, folder, out, state):
    finish(st.upsert(running_sessions(source(spark, folder), "malicious", "client"), out, state, partitions=2))
    return sorted(map(tuple, st.latest(spark, out, KEY).select(
        "client", "session_start", "session_end", "flows", "state").collect()), key=lambda r: (r[0] or 0, r[1]))


def test_opens_grows_merges_and_closes(spark, folders):  # noqa: F811
    folder, out, state = folders
    drop_file(spark, folder, "a", [(1, 0, 1, True), (2, 35, 1, True), (3, 3, 1, False)])
    assert step(spark, folder, out, state) == [
        (1, at(0), at(30), 1, "open"), (1, at(35), at(65), 1, "open")]
    # 28 is timely (the watermark is 25) and joins the two; the other client's first flow is known at once
    drop_file(spark, folder, "b", [(4, 28, 1, True), (5, 40, 2, True), (6, 40, 2, True)])
    assert step(spark, folder, out, state) == [
        (1, at(0), at(65), 3, "open"), (1, at(35), at(35), 0, "merged"), (2, at(40), at(70), 2, "open")]
    drop_file(spark, folder, "c", [(7, 200, 3, True), (8, 50, 2, True)])
    assert step(spark, folder, out, state) == [
        (1, at(0), at(65), 3, "closed"), (1, at(35), at(35), 0, "merged"),
        (2, at(40), at(80), 3, "closed"), (3, at(200), at(230), 1, "open")]
    # too late: the watermark is 190; the next session of the client is its own
    drop_file(spark, folder, "d", [(9, 60, 1, True), (10, 230, 3, True), (11, 195, 2, True)])
    assert step(spark, folder, out, state)[2:] == [
        (2, at(40), at(80), 3, "closed"), (2, at(195), at(225), 1, "open"), (3, at(200), at(230), 1, "open"),
        (3, at(230), at(260), 1, "open")]


def test_closed_ones_equal_the_session_windows(spark, folders):  # noqa: F811
    folder, out, state = folders
    draw = random.Random(4)
    minutes = sorted(draw.uniform(0, 3000) for _ in range(400))
    events = [(i, m, None if i % 3 == 0 else i % 4, True) for i, m in enumerate(minutes)]
    for part in range(2):
        drop_file(spark, folder, part or "0", events[part * 200:(part + 1) * 200])
        step(spark, folder, out, state)
    whole = st.attack_sessions(spark.read.parquet(str(folder)), "malicious", "client", lateness=None)
    newest = st.latest(spark, out, KEY).select("session_start", "session_end", "client", "flows", "state")
    assert rows(newest.drop("state")) == rows(whole)
    end = at(minutes[-1] - 10)
    assert newest.where((F.col("state") == "closed") != (F.col("session_end") <= F.lit(end))).isEmpty()


def test_join_sessions_equals_one_sort():
    draw = random.Random(1)
    for _ in range(200):
        times = [draw.randrange(200) for _ in range(draw.randrange(1, 30))]
        cut = draw.randrange(len(times) + 1)
        known, _, _ = join_sessions([], [(t, t, 1) for t in times[:cut]], 7)
        got, changed, gone = join_sessions(known, [(t, t, 1) for t in times[cut:]], 7)
        want, _, _ = join_sessions([], [(t, t, 1) for t in sorted(times)], 7)
        assert got == want and sum(s[2] for s in got) == len(times)
        assert set(changed) == {s[0] for s in got if s not in known}
        assert set(gone) == {s[0] for s in known} - {s[0] for s in got}
