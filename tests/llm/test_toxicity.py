import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidegate.llm import toxicity as X

from brute import AWKWARD, DOCS

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=900):
    rnd = random.Random(2)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    docs, toxic = [], {}
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 80))]
        toxic[i] = i % 6 == 0
        if toxic[i]:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "nasty", "hateful"]))
        elif i % 50 == 1:
            words.append("Vile")
        docs.append((i, " ".join(words)))
    return docs, toxic


def test_held_out_rows(spark):
    docs, toxic = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items() if i % 3 != 2], LABELS)
    rows = {r.doc_id: r for r in X.score_documents(table, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    # labels of held-out rows are never read
    turned = labels.withColumn("toxic", F.when(X.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in X.score_documents(table, turned).collect()} == {i: r.score for i, r in rows.items()}
    kept = X.keep_clean(table.withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_risk_against_a_plain_gradient():
    """One step moves along the plain derivative of the corrected risk."""
    positive, unlabelled = [np.array([0]), np.array([0, 1])], [np.array([1]), np.array([2]), np.array([0, 2])]
    training = X.Training(steps=1, decay=0.0)

    def risk(w, b):
        g = [b + sum(w[k] for k in r) for r in positive + unlabelled]
        loss = lambda z: np.log1p(np.exp(-z))
        plus = 0.3 * np.mean([loss(z) for z in g[:2]])
        return plus + max(0.0, np.mean([loss(-z) for z in g[2:]]) - 0.3 * np.mean([loss(-z) for z in g[:2]]))

    w, b = X.non_negative_risk(positive, unlabelled, 3, 0.3, training)
    start, bias = np.zeros(3), np.log(0.3 / 0.7)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        slope = (risk(start + step, bias) - risk(start - step, bias)) / 2e-6
        assert np.sign(w[k]) == -np.sign(slope) or abs(slope) < 1e-7
    assert risk(w, b) < risk(start, bias)


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (7, 0, None)], LABELS)
    rows = X.score_documents(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in X.score_documents(docs, none).collect()} == {X.Model({}, float(np.log(0.1 / 0.9))).score("")}
    assert X.score_documents(spark.createDataFrame([], DOCS), none).count() == 0


def test_beginnings():
    assert X.terms("Abcdefg abcdxyz q1") == {"abcdefg", "abcdxyz", "q", "abcd-", "abcd--", "abcdef-", "abcdxy-"}
