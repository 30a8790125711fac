import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidegate.functions.columns import digest
from tidegate.operators import sampling as s
from tidegate.operators.ranking import hash_cuts, hash_rank

from conftest import rows


def table(spark, sizes, partitions=4):
    whole = None
    for client, n in sizes.items():
        part = spark.range(0, n, 1, partitions).select(F.lit(client).alias("client"), F.col("id").alias("key"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def test_split_is_exact_disjoint_and_complete(spark):
    sizes = {1: 1000, 2: 333, 3: 7, 4: 1}
    df = table(spark, sizes)
    train, test = s.train_test(df, 0.2, ["key"])
    got = {r["client"]: r["count"] for r in test.groupBy("client").count().collect()}
    assert got == {c: math.ceil(n * 0.2) for c, n in sizes.items()}
    assert train.unionByName(test).exceptAll(df).isEmpty()
    assert train.count() + test.count() == sum(sizes.values())
    assert train.intersect(test).isEmpty()


def test_split_without_groups(spark):
    df = table(spark, {1: 500})
    assert s.train_test(df, 0.1, ["key"], groups=[])[1].count() == 50


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(1, 400), share=st.sampled_from([0.1, 0.2, 0.5]))
def test_split_size_for_any_n(spark, n, share):
    assert s.train_test(table(spark, {1: n}), share, ["key"])[1].count() == math.ceil(n * share)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_split_does_not_depend_on_partitioning(spark, partitions):
    def picked(df):
        return rows(s.train_test(df, 0.2, ["key"])[1])

    base = table(spark, {1: 300, 2: 200})
    assert picked(base.repartition(partitions)) == picked(base)


def with_copies(spark, n=3000):
    """A third of all rows are copies of one key."""
    return spark.range(n).select(
        F.lit(1).alias("client"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), "id"
    )


@pytest.mark.parametrize("seed", ["a", "b", "c", "d"])
def test_split_stays_exact_with_a_hot_key(spark, seed):
    df = with_copies(spark)
    train, test = s.train_test(df, 0.2, ["key"], seed=seed)
    assert (train.count(), test.count()) == (2400, 600)
    assert train.intersect(test).isEmpty()


def test_hot_key_astride_the_cut_is_divided(spark):
    # every row is a copy, so the cut must fall inside the copies
    df = spark.range(1000).select(F.lit(1).alias("client"), F.lit(7).alias("key"), "id")
    train, test = s.train_test(df, 0.2, ["key"])
    assert (train.count(), test.count()) == (800, 200)
    assert train.intersect(test).isEmpty()


def test_prefix_path_finds_the_same_cut(spark):
    df = table(spark, {1: 5000, 2: 1000})
    from tidegate.operators.ranking import _cuts_by_prefix
    from tidegate.session import pinned

    h = digest("x", "key")
    k = F.ceil(F.col("n") * 0.3)
    fast = hash_cuts(df, h, k, ["client"])
    sizes = pinned(df.groupBy("client").agg(F.count("*").alias("n")).withColumn("k", k.cast("bigint")))
    slow = _cuts_by_prefix(df.select("client", h.alias("_h")), sizes, ["client"], rows_per_bucket=3)
    assert rows(fast) == rows(slow)


def test_rank_is_a_permutation_in_hash_order(spark):
    df = table(spark, {1: 800, 2: 300})
    h = digest("r", "key")
    for limit in (1_000_000, 20):
        ranked = hash_rank(df, h, ["client"], rows_per_bucket=limit).withColumn("h", h)
        for client, n in ((1, 800), (2, 300)):
            found = ranked.where(F.col("client") == client).orderBy("row_idx").collect()
            assert [r["row_idx"] for r in found] == list(range(n))
            assert [r["h"] for r in found] == sorted(r["h"] for r in found)


def test_rank_spreads_copies_of_a_hot_key(spark):
    df = with_copies(spark)
    ranked = hash_rank(df, digest("r", "key"), ["client"], rows_per_bucket=50)
    assert sorted(r["row_idx"] for r in ranked.collect()) == list(range(3000))
    assert ranked.select("id").distinct().count() == 3000


def test_epochs_shuffle_differently(spark):
    df = table(spark, {1: 200})
    orders = [
        [r["key"] for r in s.shuffle_rows(df, ["key"], epoch=e).orderBy("row_idx").collect()] for e in (0, 1, 0)
    ]
    assert orders[0] == orders[2] != orders[1]


def test_only_the_last_batch_is_short(spark):
    batches = s.mini_batches(s.shuffle_rows(table(spark, {1: 100, 2: 31}), ["key"]), 32)
    got = rows(batches.groupBy("client", "batch_id").count())
    assert got == [(1, 0, 32), (1, 1, 32), (1, 2, 32), (1, 3, 4), (2, 0, 31)]


def test_mixture_has_the_size_and_repeats_rows(spark):
    df = table(spark, {1: 40, 2: 5, 3: 5})
    mixed = s.mixture_sample(df, 300, ["key"])
    assert mixed.count() == 300
    per_client = {r["client"]: r["count"] for r in mixed.groupBy("client").count().collect()}
    assert all(60 < per_client[c] < 140 for c in (1, 2, 3))     # groups uniformly, whatever their size
    assert mixed.select("slot").distinct().count() == 300


def test_mean_holdout_size_is_whole(spark):
    assert s.mean_holdout_size(table(spark, {1: 5543, 2: 856, 3: 475})).first()[0] == 2291


def test_applying_a_split_does_not_shuffle_rows(spark):
    marked = s.split_by_share(table(spark, {1: 100, 2: 50}), 0.2, ["key"])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
