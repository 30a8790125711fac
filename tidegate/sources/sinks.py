"""Writers and their readers: CSV tables, accuracy reports, parameters, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import two_decimals
from ..operators.networks import Layout


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and without a row index; ``inf`` and ``NaN`` can be read back."""
    df.write.mode(mode).option("header", True).csv(path)


def accuracy_lines(accuracies: DataFrame) -> DataFrame:
    """(dataset, algorithm, repeat, accuracy as text with two decimals)."""
    return accuracies.select("dataset", "algorithm", "repeat", two_decimals("accuracy").alias("accuracy"))


def write_accuracy_report(accuracies: DataFrame, path: str) -> bool:
    """One folder per (dataset, algorithm), replacing earlier reports; a failure is printed, not raised."""
    try:
        accuracy_lines(accuracies).write.mode("overwrite").partitionBy("dataset", "algorithm").option(
            "header", True
        ).csv(path)
    except Exception as problem:  # the report must not end the comparison
        print(f"accuracy report not written: {problem}")
        return False
    return True


def save_parameters(params: DataFrame, path: str) -> None:
    """Averaged parameters, one folder per round; a round saved again replaces itself, the others stay."""
    params.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def load_parameters(spark: SparkSession, path: str, layout: Layout, round_: int | None = None) -> list[float]:
    """Parameters of one round, the last one by default; their number must fit the layout."""
    stored = spark.read.parquet(path)
    if round_ is None:
        round_ = stored.agg(F.max("round")).first()[0]
    found = stored.where(F.col("round") == F.lit(round_)).select("w").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"round {round_}: {len(found)} parameter rows")
    w = list(found[0]["w"])
    if len(w) != layout.n_parameters:
        raise ValueError(f"{len(w)} parameters stored, {layout.name} has {layout.n_parameters}")
    return w


def write_trials(trials: DataFrame, path: str, source: str = "parquet", mode: str = "overwrite") -> None:
    trials.write.mode(mode).format(source).option("header", True).save(path)


def read_trials(spark: SparkSession, path: str, schema: str | None = None, source: str = "parquet") -> DataFrame:
    reader = spark.read.format(source).option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)
