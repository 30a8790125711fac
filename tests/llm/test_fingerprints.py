"""Bottom-k sketches against plain Python over the whole sf0.001 table and awkward rows."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidegate.llm import fingerprints as M
from tidegate.llm.tables import table

from brute import AWKWARD, DOCS, words
from conftest import SF


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    out = set()
    for i in range(max(1, len(w) - n + 1)):
        h = 42
        for x in w[i:i + n]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.add(signed(h))
    return out


def plain(text, size=M.SIZE):
    return sorted(shingles(text))[:size]


def likeness(a, b, size=M.SIZE):
    least = min([s[-1] for s in (a, b) if len(s) >= size], default=1 << 63)
    x, y = ({h for h in s if h <= least} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def held_against(rows, docs, size=M.SIZE):
    """docs: (doc_id, text), no two of the same id."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(docs)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        new = edited(text, following)
        own, other, after = plain(text, size), plain(new, size), plain(following, size)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in own)
        assert r.edited_fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in other)
        assert r.near_edited == pytest.approx(likeness(own, other, size))
        assert r.near_next == pytest.approx(likeness(own, after, size))


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    held_against(M.fingerprints(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_any_number_of_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(rnd.randrange(-10 ** 12, 10 ** 12), " ".join(rnd.choices("abcdefgh", k=rnd.randrange(30)))) for _ in range(300)]
    docs = list({i: (i, t) for i, t in docs}.values()) + [(None, "n u l l")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    for sampled in (1, 64):
        monkeypatch.setattr(M, "_SAMPLED", sampled)
        held_against(M.fingerprints(df, size=8).collect(), docs, 8)


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    rows = M.fingerprints(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in AWKWARD)
    same = {}
    for r in rows:
        same.setdefault(next(t for i, t, *_ in AWKWARD if i == r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    ones = [r for r in rows if r.doc_id == 1]          # repeated rows: the first is followed by its copy
    assert len(ones) == 2 and 1.0 in {r.near_next for r in ones}
    assert M.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    alone = M.fingerprints(spark.createDataFrame([(4, "a b c d")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def test_parts_merge_to_the_whole(spark):
    rnd = random.Random(8)
    texts = {k: [" ".join(rnd.choices("abcdefghijkl", k=40)) for _ in range(n)] for k, n in (("x", 500), ("y", 1), ("z", 65))}
    parts = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)] + [("x", None, None), ("y", 0, "again a b c d")]
    df = spark.createDataFrame(parts, "k string, part int, t string").withColumn("s", M.sketch(F.col("t")))
    got = {r.k: r.s for r in M.merged(df, "k", "part", "s").collect()}
    for k in texts:
        want = sorted(set().union(*(shingles(t) for i, _, t in parts if i == k)))[:M.SIZE]
        assert got[k] == want
    assert M.merged(df.limit(0), "k", "part", "s").count() == 0


def test_estimates(spark):
    rnd = random.Random(1)
    common = [f"w{rnd.random()}" for _ in range(3_000)]
    a, b = " ".join(common), " ".join(common[:2_000] + [f"v{i}" for i in range(500)])
    truth_a, truth_b = shingles(a), shingles(b)
    size = 512
    s, t = M.sketch(F.col("a"), size), M.sketch(F.col("b"), size)
    r = spark.createDataFrame([(a, b)], "a string, b string").select(
        M.resemblance(s, t, size).alias("j"), M.containment(t, s, size).alias("c"), M.distinct_count(s, size).alias("n"),
        M.merge(s, t, size).alias("m")).first()
    assert abs(r.j - len(truth_a & truth_b) / len(truth_a | truth_b)) < 0.1
    assert abs(r.c - len(truth_a & truth_b) / len(truth_b)) < 0.1
    assert abs(r.n / len(truth_a) - 1) < 0.15
    assert r.m == sorted(truth_a | truth_b)[:size]
