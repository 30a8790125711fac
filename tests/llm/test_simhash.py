import random

from pyspark.sql import functions as F

from tidegate.llm import simhash as M
from tidegate.llm.components import components

from brute import AWKWARD, DOCS, component_ids, fingerprint


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    rows = M.near_duplicates(docs).collect()
    marks = [(r[0], fingerprint(r[1])) for r in AWKWARD]
    want = sorted(repr((d, f"{m:016x}", c)) for (d, m), c in zip(marks, component_ids(marks)))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == want
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component_ids(marks)))
    assert M.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert M.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_all_null_keep_one(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z")], "doc_id bigint, text string")
    assert sorted(r.text for r in M.keep_one(docs).collect()) == ["a b c", "x y z"]


def test_no_link_is_lost(spark):
    rnd = random.Random(5)
    marks = set()
    for _ in range(60):
        m = rnd.getrandbits(64)
        for _ in range(6):
            marks.add(m)
            for _ in range(rnd.randrange(1, 5)):
                m ^= 1 << rnd.randrange(64)
    marks |= {0, 1, 7, 15, (1 << 64) - 1, 1 << 63}
    marks |= {5 << 32 | rnd.getrandbits(32) for _ in range(40)}       # a crowded segment
    ordered = sorted(marks)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(signed(m),) for m in ordered], "mark bigint")
    for segments, crowded in ((2, 256), (2, 4), (2, 0), (3, 256), (4, 2)):
        got = {tuple(sorted(r)) for r in M.links(df, 3, segments, crowded).collect()}
        assert got == want, (segments, crowded)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_long_text_in_parts(spark, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5_000))
    whole = M.fingerprint(text)
    monkeypatch.setattr(M, "_SHINGLES", 64)
    assert M.fingerprint(text) == whole == fingerprint(text)


def test_hex(spark):
    df = spark.createDataFrame([(-1,), (0,), (255,)], "m bigint")
    assert [r[0] for r in df.select(M.hex_fingerprint(F.col("m"))).collect()] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]


def test_equal_ids_and_marks_keep_the_same_text_in_every_run(spark):
    # blanks do not change a fingerprint: four texts of one id and one fingerprint
    rows = [(1, "a  b c"), (1, "a b c"), (1, "a b  c"), (1, "A b c"), (2, "other words here")]
    found = set()
    for parts in (1, 2, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        kept = M.keep_one(docs).collect()
        assert sorted(r.doc_id for r in kept) == [1, 2]
        found |= {r.text for r in kept if r.doc_id == 1}
    assert len(found) == 1
