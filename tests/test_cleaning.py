import pytest
from pyspark.sql import functions as F

from tidegate.operators import cleaning as c

from conftest import rows

NAN, INF = float("nan"), float("inf")


def test_absent_identifiers_are_ignored(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "client int, protocol string, f01 double")
    assert c.drop_identifiers(df).columns == ["client", "f01"]


def test_fill_gaps_leaves_text_unless_asked(spark):
    df = spark.createDataFrame([(None, None), (NAN, "x"), (2.0, "y")], "f double, t string")
    assert rows(c.fill_gaps(df)) == [(0.0, "x"), (0.0, None), (2.0, "y")]
    assert rows(c.fill_gaps(df, strings=True)) == [(0.0, "0"), (0.0, "x"), (2.0, "y")]


def test_repeated_headers_get_numbers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" x", "x ", " Label")
    assert c.trim_headers(df).columns == ["x", "x.1", "Label"]


def test_infinities_and_gaps_become_zero(spark):
    df = spark.createDataFrame([(v, 1) for v in (NAN, INF, -INF, None, 1.5, -0.5)], "f double, k int")
    assert sorted(r[0] for r in c.repair_infinities(df).collect()) == [-0.5, 0.0, 0.0, 0.0, 0.0, 1.5]


def test_repair_handles_odd_column_names(spark):
    df = spark.createDataFrame([(INF, 2.0)], "a double, b double").toDF("f.1", "f`2")
    assert rows(c.repair_infinities(df)) == [(0.0, 2.0)]


def test_missing_label_is_malignant(spark):
    df = spark.createDataFrame([("BENIGN",), ("DDoS",), (None,)], "Label string")
    assert sorted(r[0] for r in c.binarise_label(df).collect()) == ["BENIGN", "MALIGNANT", "MALIGNANT"]


def test_codes_come_from_train_only(spark):
    train = spark.createDataFrame([("MALIGNANT",), ("BENIGN",), ("BENIGN",)], "Label string")
    test = spark.createDataFrame([("MALIGNANT",), ("OTHER",)], "Label string")
    codes = c.fit_label_codes(train)
    assert rows(codes) == [("BENIGN", 0), ("MALIGNANT", 1)]
    # a test set with one class keeps that class's code
    assert rows(c.encode_label(test, codes)) == [("MALIGNANT", 1), ("OTHER", None)]


def test_width_check(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 2.0), (1, NAN, 1.0)], "client int, a double, b double")
    with pytest.raises(ValueError):
        c.require_width(df, ["a"], 2)
    packed = c.assemble_features(df, ["a", "b"])
    assert rows(c.width_violations(packed, 2, groups=["client"])) == [(1, 3, 2)]
    assert rows(c.width_violations(packed, 3)) == [(3, 3)]


def test_dirty_text_casts_to_null(spark):
    df = spark.createDataFrame([("1.5", "1"), ("x", "y")], "f string, label string")
    assert rows(c.cast_types(df, ["f"], "label")) == [(1.5, 1), (None, None)]


def test_cleaning_is_one_projection(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("f"), F.lit("BENIGN").alias("Label"))
    plan = c.binarise_label(c.repair_infinities(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
