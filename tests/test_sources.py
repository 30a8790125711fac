import pytest
from pyspark.sql import functions as F

from tidegate.operators import cleaning
from tidegate.sources import flows as src, sinks

from conftest import rows


def test_day_table_with_odd_header_and_values(spark, tmp_path):
    """Blanks around names, a repeated name, infinities, NaN, a gap and a missing label."""
    path = tmp_path / "day.csv"
    path.write_text(" f01,f02 , f02, Label\n1.5,Infinity,inf,BENIGN\n-inf,NaN,,DDoS\n2,3,4,\n")
    df = src.read_flows(spark, str(path), src.day_schema(["f01", "f02", "f03"]))
    assert df.columns == ["f01", "f02", "f03", "Label"]
    clean = cleaning.binarise_label(cleaning.repair_infinities(df))
    assert rows(clean) == sorted([
        (1.5, 0.0, 0.0, "BENIGN"), (0.0, 0.0, 0.0, "MALIGNANT"), (2.0, 3.0, 4.0, "MALIGNANT"),
    ], key=str)


def test_slice_family(spark, tmp_path):
    schema = src.slice_schema(["f01", "f02"])
    assert len(src.slice_schema()) == 11 + 49 + 3 + 1 and len(src.day_schema()) == 79
    assert len(src.SLICE_FILES) == 3 and len(src.DAY_FILES) == 7
    header = ",".join(schema.fieldNames())
    for client, name in src.SLICE_FILES.items():
        lines = [",".join(["x"] * 9 + ["1", "2", str(client), "", "a", "b", "c", str(i % 2)]) for i in range(client)]
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")
    paths = src.catalog(str(tmp_path), src.SLICE_FILES)
    table = cleaning.fill_gaps(cleaning.drop_identifiers(src.read_catalog(spark, paths, schema)))
    assert table.columns == ["f01", "f02", src.SLICE_LABEL, "client"]
    assert rows(table.groupBy("client").agg(F.count("*"), F.sum("f01"), F.sum("f02"))) == [
        (1, 1, 1.0, 0.0), (2, 2, 4.0, 0.0), (3, 3, 9.0, 0.0),
    ]
    assert src.read_catalog(spark, paths, schema, clients=[2]).count() == 2
    with pytest.raises(KeyError):
        src.read_catalog(spark, paths, schema, clients=[9])


def test_inferred_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    assert src.read_flows(spark, str(tmp_path / "a.csv")).dtypes == [("x", "int"), ("y", "string")]


def test_client_folders_are_pruned(spark, tmp_path):
    df = spark.range(30).select((F.col("id") % 3).cast("int").alias("client"), "id")
    src.write_by_client(df, str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).where("client = 1")
    assert one.count() == 10
    assert all("client=1" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(client" in (
        one._jdf.queryExecution().executedPlan().toString()
    )


def test_positional_reader(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0, 1)], "a double, b double, ignored double, y int")
    assert rows(src.positional_test_set(df, 2)) == [([1.0, 2.0], 1)]
    with pytest.raises(ValueError):
        src.positional_test_set(df, 4)


def test_report_has_two_decimals_and_is_replaced(spark, tmp_path, capsys):
    schema = "dataset int, algorithm string, repeat int, accuracy double"
    path = str(tmp_path / "report")
    for value in (12.3456, 87.555):
        assert sinks.write_accuracy_report(spark.createDataFrame([(1, "KNN", 1, value)], schema), path)
    back = spark.read.option("header", True).schema("repeat int, accuracy string").csv(path + "/dataset=1/algorithm=KNN")
    assert rows(back) == [(1, "87.56")] or rows(back) == [(1, "87.55")]
    (tmp_path / "file").write_text("in the way")
    bad = spark.createDataFrame([(1, "KNN", 1, 1.0)], schema)
    assert not sinks.write_accuracy_report(bad, str(tmp_path / "file" / "below"))
    assert "not written" in capsys.readouterr().out


def test_trials_round_trip(spark, tmp_path):
    schema = "number int, value double, params_optimizer string"
    trials = spark.createDataFrame([(1, 0.5, "SGD"), (2, 0.75, "Adam")], schema)
    for source in ("csv", "parquet"):
        path = str(tmp_path / source)
        sinks.write_trials(trials, path, source)
        assert rows(sinks.read_trials(spark, path, schema, source)) == rows(trials)


def test_columns_by_header_name(spark, tmp_path):
    path = tmp_path / "day.csv"
    path.write_text(" Label ,F02, f01 ,extra\nBENIGN,2.5,1,x\nDoS,inf,bad,y\nDoS,,NaN,z\n")
    schema = src.day_schema(["f01", "f02"])
    got = src.read_flows_by_name(spark, str(path), schema)
    assert got.columns == ["f01", "f02", "Label"]
    assert [repr(tuple(r)) for r in got.collect()] == [
        "(1.0, 2.5, 'BENIGN')", "(None, inf, 'DoS')", "(nan, None, 'DoS')"]
    counts = {r["column"]: r["malformed"] for r in src.malformed_values(spark, str(path), schema).collect()}
    assert counts == {"f01": 1, "f02": 0, "Label": 0}
    with pytest.raises(ValueError):
        src.read_flows_by_name(spark, str(path), src.day_schema(["f03"]))
