"""The whole pipeline on sf0.001 against plain versions of its stages."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidegate.llm import decontamination, quality_rules, toxicity
from tidegate.llm.queries import tokenizer
from tidegate.llm.tables import table
from tidegate.llm.tokens import encoder

from brute import AWKWARD, DOCS, base_failed, component_ids, edit_distance_inside, fingerprint
from conftest import SF


@pytest.fixture(scope="module")
def steps(spark):
    out, docs = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).persist()
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_columns_stay_until_the_last(steps):
    assert [s[3] for s in steps[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, steps):
    _, before, after, _ = steps[0]
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = quality_rules.learn(quality_rules.labelled_features(docs, labels))
    rows, c = quality_rules.with_counts(docs)
    values = rows.select("doc_id", *(v.alias(k) for k, v in quality_rules.features(c).items())).collect()
    rejected = {r.doc_id for r in values if any(
        all((r[x.feature] > x.threshold) == x.above for x in rule) for rule in rules)}
    assert sorted(r.doc_id for r in after) == sorted(
        r.doc_id for r in before if not base_failed(r.text) and r.doc_id not in rejected)


def test_toxicity(spark, steps):
    _, before, after, _ = steps[1]
    model = toxicity.learn(spark.createDataFrame(before), table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.score(r.text) < 0.5)


def test_near_duplicates(steps):
    _, before, after, _ = steps[2]
    ids = component_ids([(r.doc_id, fingerprint(r.text)) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(ids))


def test_decontamination(steps):
    _, before, after, _ = steps[3]
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    normal = lambda t: "".join(map(chr, decontamination.normal(t)[0]))
    whole = {r.doc_id for r in before if any(normal(i) in normal(r.text) for i, in items)}
    kept = {r.doc_id for r in after}
    assert not kept & whole
    gone = {r.doc_id: r.text for r in before if r.doc_id not in kept | whole}
    for text in gone.values():          # dropped for an edited passage: some tile is really that near
        near = [(t, int(len(t) * 0.1)) for i, in items for _, t in decontamination.tiles_of(i, 96)]
        assert any(edit_distance_inside("".join(map(chr, t)), normal(text)) <= e for t, e in near)


def test_packing(steps):
    _, before, after, _ = steps[4]
    encode = encoder(tokenizer())
    sizes = {r.doc_id: len(np.frombuffer(encode(r.text or ""), "<u4")) + 1 for r in before}
    found, used = {}, {}
    for r in after:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert found == sizes and max(used.values()) <= 1024
    assert len(used) <= sum(sizes.values()) / 1024 * 1.02 + 2


def test_run_gives_the_last_stage(spark, steps):
    rows = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, steps[4][2]))


def test_awkward_rows_through_all_stages(spark):
    good = [(100 + k, " ".join(f"plain{(7 * i + k) % 97}" for i in range(80)) + ".", "en", "s", 9, "m", "s", "q") for k in range(3)]
    docs = spark.createDataFrame(AWKWARD + good + good[:1], DOCS)
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert {r.doc_id for r in docs.collect()} <= kept
        kept = {r.doc_id for r in docs.collect()}
    # all short, blank and repetitive texts are gone, of the repeated row one is left
    assert kept == {100, 101, 102} and docs.count() == 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == kept
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), SF).limit(0) if "text" in empty.columns else empty
        assert empty.count() == 0
