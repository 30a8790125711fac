import math

import pytest
from pyspark.sql import functions as F

from tidegate.functions.columns import argmax, binary_cross_entropy, cross_entropy, percent, softmax
from tidegate.operators import metrics as m

from conftest import rows


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2 + [(2, 0)] * 1
    df = spark.createDataFrame(pairs, "label bigint, pred bigint")
    got = {r["line"]: r for r in m.classification_report(df).collect()}
    assert got["0"]["precision"] == pytest.approx(5 / 8) and got["0"]["recall"] == pytest.approx(5 / 6)
    assert got["1"]["f1"] == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    assert (got["2"]["precision"], got["2"]["recall"], got["2"]["f1"], got["2"]["support"]) == (0, 0, 0, 1)
    assert got["accuracy"]["f1"] == pytest.approx(7 / 11)
    assert got["macro avg"]["recall"] == pytest.approx((5 / 6 + 0.5 + 0) / 3)
    assert got["weighted avg"]["recall"] == pytest.approx(7 / 11)


def test_report_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(500).select((F.col("id") % 3).alias("label"), (F.col("id") * 7 % 11 % 3).alias("pred"))
    doubles = df.select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction"))
    got = {r["line"]: r for r in m.classification_report(df).collect()}
    for name, line, column in (
        ("accuracy", "accuracy", "f1"), ("weightedPrecision", "weighted avg", "precision"), ("f1", "weighted avg", "f1"),
    ):
        want = MulticlassClassificationEvaluator(metricName=name).evaluate(doubles)
        assert got[line][column] == pytest.approx(want)


def test_losses_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([800.0, -800.0, 0.0], 1)], "scores array<double>, label bigint")
    got = df.select(cross_entropy("scores", "label"), argmax("scores"), softmax("scores")).collect()
    assert got[0][0] == pytest.approx(-math.log(math.exp(3) / (math.e + 2 * math.exp(3)))) and got[0][1] == 1
    assert got[1][0] == pytest.approx(1600.0) and got[1][1] == 0
    assert sum(got[0][2]) == pytest.approx(1)
    p = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.25, 0)], "p double, label int")
    assert [r[0] for r in p.select(binary_cross_entropy("p", "label")).collect()] == pytest.approx(
        [100.0, 0.0, -math.log(0.75)]
    )


def test_loss_is_the_sum_of_batch_means(spark):
    data = [([0.0, 0.0], 0, 0), ([0.0, 0.0], 1, 0), ([0.0, math.log(3)], 1, 1)]
    df = spark.createDataFrame(data, "scores array<double>, label bigint, batch_id bigint")
    assert m.evaluation_loss(df).first()["loss"] == pytest.approx(math.log(2) + math.log(4 / 3))
    assert m.evaluation_loss(df, how="row_mean").first()["loss"] == pytest.approx((2 * math.log(2) + math.log(4 / 3)) / 3)
    with pytest.raises(ValueError):
        m.evaluation_loss(df, how="other")


def test_published_round_means(spark):
    """Three data sets' accuracies of one published round: their mean, and the last one's loss."""
    data = [(3, 3, 569.1158264577389, 99.98), (3, 4, 349.29404950141907, 98.60), (3, 5, 879.7083642780781, 85.64)]
    df = spark.createDataFrame(data, "round int, dataset int, loss double, accuracy_pct double")
    r = m.summarise_data_sets(df).first()
    assert r["mean_accuracy_pct"] == pytest.approx(94.74, abs=0.01) and r["loss"] == 879.7083642780781
    assert r["losses"] == [569.1158264577389, 349.29404950141907, 879.7083642780781]


def test_published_weighted_loss(spark):
    """The row-weighted mean over clients lies between the clients' values."""
    df = spark.createDataFrame([(1, 57721, 0.9), (1, 34074, 0.5), (1, 57294, 0.7)], "round int, n bigint, accuracy double")
    value = m.weighted_mean(df).first()["accuracy"]
    assert value == pytest.approx((57721 * 0.9 + 34074 * 0.5 + 57294 * 0.7) / 149089)


def test_no_rows_divide_to_null(spark):
    df = spark.createDataFrame([(1, 0, 0.5)], "round int, n bigint, accuracy double")
    assert m.weighted_mean(df).first()["accuracy"] is None


def test_repeat_summary_of_published_knn(spark):
    df = spark.createDataFrame([(1, "KNN", i, 87.56) for i in range(1, 11)], "dataset int, algorithm string, repeat int, accuracy double")
    r = m.repeat_summary(df).first()
    assert (r["repeats"], round(r["mean"], 2), round(r["sd"], 6), r["min"], r["max"]) == (10, 87.56, 0.0, 87.56, 87.56)


def test_percent_rounds_before_the_mean(spark):
    assert spark.range(1).select(percent(F.lit(0.987654))).first()[0] == 98.77


def test_label_counts_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "Label string")
    assert [tuple(r) for r in m.label_counts(df).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_rollup_has_total(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 1)], "client int, label int, pred int")
    assert rows(m.accuracy_with_total(df, "label", "pred")) == [(1, 2, 0.5), (2, 1, 1.0), (None, 3, pytest.approx(2 / 3))]
