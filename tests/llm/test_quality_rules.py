import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegate.llm import quality_rules as Q

from brute import AWKWARD, DOCS, base_failed, counts
from conftest import SF

LABELS = "doc_id bigint, quality int, toxic int"


def test_counts_of_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], LABELS)
    rows = Q.judge(docs, labels).collect()
    want = sorted(repr((r[0], *counts(r[1]), base_failed(r[1]))) for r in AWKWARD)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                  for r in rows) == want
    assert not any(r.kept for r in rows)
    assert Q.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("hash_bits", [1, 4, 64])
def test_repeats_are_told_by_their_words(spark, hash_bits):
    """With few bits left nearly all windows share them; the counts stay exact."""
    rnd = random.Random(hash_bits)
    texts = [" ".join(rnd.choice("ab cd ef".split()) for _ in range(rnd.randrange(40))) for _ in range(60)]
    texts += [" ".join(f"w{rnd.randrange(40)}" for _ in range(300)), "a b c a b c", "a b c", "x y", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows, c = Q.with_counts(docs, hash_bits=hash_bits)
    got = {r.doc_id: r.n for r in rows.select("doc_id", F.col(c["n_repeat_words"]).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        assert got[i] == len({k + d for k, g in enumerate(grams) if g in twice for d in range(3)}), t


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert Q.judge(docs, labels).count() == 0
    some = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "en", "s", 1, "", "", "")], DOCS)
    assert [r.kept for r in Q.judge(some, labels).collect()] == [True]


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    rules = Q.learn(Q.labelled_features(docs, labels.where("doc_id % 2 = 0")))
    rows, c = Q.with_counts(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"))
    return rules, rows.select("text", "quality", Q.verdict(rules, c).alias("rule"), Q.base_failed(c).alias("failed")).collect()


def test_held_out_documents(judged):
    rules, rows = judged
    assert rules
    kept = [not r.failed and r.rule is None for r in rows]
    good = [r.quality == 1 and not r.failed for r in rows]
    assert sum(k == g for k, g in zip(kept, good)) >= 0.98 * len(rows)
    assert sum(k for k, g in zip(kept, good) if g) >= 0.99 * sum(good)
    assert [r.failed for r in rows] == [base_failed(r.text) for r in rows]


def test_thresholds_stand_in_the_gap(spark):
    rows = [(i, i % 4 == 0, 0.5 if i % 4 == 0 else 0.1, float(i % 7)) for i in range(400)]
    rules = Q.learn(spark.createDataFrame(rows, "id bigint, bad boolean, share double, noise double"))
    assert len(rules) == 1 and len(rules[0]) == 1
    assert rules[0][0].feature == "share" and rules[0][0].above and 0.1 < rules[0][0].threshold < 0.5


def test_conjunctions_are_found_in_order(spark):
    rows = []
    for i in range(900):
        a, b, c = i % 3, (i // 3) % 3, (i // 9) % 5
        rows.append((i, (a == 2 and b == 2) or c == 4, float(a), float(b), float(c)))
    rules = Q.learn(spark.createDataFrame(rows, "id bigint, bad boolean, a double, b double, c double"))
    assert [sorted(x.feature for x in r) for r in rules] in ([["c"], ["a", "b"]], [["a", "b"], ["c"]])
