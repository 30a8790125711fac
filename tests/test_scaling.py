import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import scaling
from tidegate.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def frame(spark, n=2500):
    rng = np.random.default_rng(3)
    values = np.column_stack([
        rng.lognormal(0, 2, n), rng.integers(0, 5, n).astype(float), np.full(n, 4.25),
    ])
    client = np.where(rng.random(n) < 0.7, 1, 2)
    data = [(int(c), *map(float, v)) for c, v in zip(client, values)]
    return spark.createDataFrame(data, "client int, a double, b double, c double"), client, values


@pytest.mark.parametrize("limits", [{}, {"direct_rows": 0}, {"direct_rows": 0, "window_rows": 5}])
@pytest.mark.parametrize("groups", [["client"], []])
def test_quantiles_equal_numpy(spark, limits, groups):
    df, client, values = frame(spark)
    got = exact_quantiles(df, ["a", "b", "c"], PROBS, groups, **limits).collect()
    assert len(got) == 15 * (2 if groups else 1)
    for r in got:
        part = values[client == r["client"]] if groups else values
        want = np.quantile(part[:, "abc".index(r["column"])], r["prob"])
        assert r["value"] == pytest.approx(want, rel=1e-12)


def test_quantiles_when_a_third_is_one_value(spark):
    data = [(1, 5.0 if i % 3 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "client int, a double")
    for limits in ({}, {"direct_rows": 0, "window_rows": 10}):
        got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["a"], [0.2, 0.5], ["client"], **limits).collect()}
        assert got == {p: pytest.approx(np.quantile([v for _, v in data], p)) for p in (0.2, 0.5)}


def test_standard_scaling_of_train_rows(spark):
    df, _, _ = frame(spark)
    stats = scaling.fit_standard(df, ["a", "b", "c"])
    scaled = scaling.scale(df, stats, ["a", "b", "c"])
    for r in scaled.groupBy("client").agg(
        *[f(c).alias(f"{n}_{c}") for c in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).collect():
        assert r["m_a"] == pytest.approx(0, abs=1e-9) and r["s_a"] == pytest.approx(1)
        assert r["m_c"] == pytest.approx(0) and r["s_c"] == pytest.approx(0)      # constant: scale 1


def test_robust_scaling_of_a_constant_column(spark):
    df, client, values = frame(spark)
    stats = scaling.fit_robust(df, ["b", "c"]).where("client = 1").first()
    part = values[client == 1][:, 1]
    q1, q2, q3 = np.quantile(part, [0.25, 0.5, 0.75])
    assert (stats["center_b"], stats["scale_b"]) == (q2, q3 - q1)
    assert (stats["center_c"], stats["scale_c"]) == (4.25, 1.0)


def test_global_scaler_is_one_row(spark):
    df, _, values = frame(spark)
    stats = scaling.fit_standard(df, ["a"], [])
    assert stats.count() == 1 and stats.first()["center_a"] == pytest.approx(values[:, 0].mean())
    assert scaling.scale(df, stats, ["a"], []).agg(F.avg("a")).first()[0] == pytest.approx(0, abs=1e-9)


def test_approximate_robust_is_close(spark):
    df, client, values = frame(spark)
    stats = scaling.fit_robust(df, ["a"], approximate=True).where("client = 1").first()
    assert stats["center_a"] == pytest.approx(np.median(values[client == 1][:, 0]), rel=0.01)


def test_brackets_on_a_larger_table(spark):
    """Enough rows for real brackets; the two paths must agree to the last digit."""
    df = spark.range(120_000).select(
        (F.col("id") % 2).cast("int").alias("client"), F.sin(F.col("id") * 1.7).alias("a"),
        F.floor(F.rand(1) * 4).cast("double").alias("b"), F.exp(F.randn(2) * 3).alias("c"),
    )
    direct = exact_quantiles(df, ["a", "b", "c"], PROBS, ["client"])
    narrowed = exact_quantiles(df, ["a", "b", "c"], PROBS, ["client"], direct_rows=0, window_rows=50)
    key = lambda r: (r["client"], r["column"], r["prob"])
    for a, b in zip(sorted(direct.collect(), key=key), sorted(narrowed.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["value"] == pytest.approx(b["value"], rel=1e-12)
