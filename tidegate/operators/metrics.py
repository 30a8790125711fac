"""Metrics and reports: grouped aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import binary_cross_entropy, cross_entropy, percent


def label_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per label, most frequent first, label as tie-break."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def is_hit(label: str = "label", pred: str = "pred") -> Column:
    """1 for a right prediction; a missing label or prediction is never right."""
    return F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", groups: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions per group."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(is_hit(label, pred)).alias("accuracy"))


def accuracy_with_total(df: DataFrame, label: str, pred: str, group: str = "client") -> DataFrame:
    """Accuracy per group and over all groups (NULL group) in one rollup."""
    return df.rollup(group).agg(F.count("*").alias("n"), F.avg(is_hit(label, pred)).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", groups: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction); the only pass over the scored rows a report needs."""
    return df.groupBy(*groups, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred", groups: Sequence[str] = ()
) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted means.

    A ratio with an empty denominator is 0. ``line`` names the class or the mean.
    """
    groups = list(groups)
    cells = confusion(df, label, pred, groups)
    # each cell counts for its true class and for its predicted class
    sides = cells.select(*groups, F.explode(F.array(
        F.struct(
            F.col("label").cast("string").alias("line"),
            F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
            F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("claimed"),
        ),
        F.struct(
            F.col("pred").cast("string").alias("line"), F.lit(0).cast("bigint").alias("hit"),
            F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("claimed"),
        ),
    )).alias("_s")).select(*groups, "_s.*")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    classes = (
        sides.groupBy(*groups, "line")
        .agg(F.sum("hit").alias("hit"), F.sum("truth").alias("support"), F.sum("claimed").alias("claimed"))
        .withColumn("precision", ratio(F.col("hit"), F.col("claimed")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    scores = ("precision", "recall", "f1")
    totals = classes.groupBy(*groups).agg(
        F.sum("support").alias("support"),
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(f"weighted_{s}") for s in scores],
    )
    means = totals.select(*groups, F.explode(F.array(
        F.struct(
            F.lit("accuracy").alias("line"), *[F.col("accuracy").alias(s) for s in scores], F.col("support")
        ),
        *[
            F.struct(F.lit(f"{kind} avg").alias("line"), *[F.col(f"{kind}_{s}").alias(s) for s in scores], F.col("support"))
            for kind in ("macro", "weighted")
        ],
    )).alias("_m")).select(*groups, "_m.*")
    return classes.select(*groups, "line", *scores, "support").unionByName(means)


def evaluation_loss(
    df: DataFrame, scores: str = "scores", label: str = "label", batch: str = "batch_id",
    groups: Sequence[str] = (), how: str = "sum_of_batch_means",
) -> DataFrame:
    """Cross-entropy over scored rows.

    ``how``: ``sum_of_batch_means`` adds up the mean of every batch and does not
    divide; ``row_mean`` is the plain mean.
    """
    rows = df.withColumn("_loss", cross_entropy(scores, label))
    if how == "row_mean":
        return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_loss").alias("loss"))
    if how != "sum_of_batch_means":
        raise ValueError(how)
    batches = rows.groupBy(*groups, batch).agg(F.avg("_loss").alias("_mean"), F.count("*").alias("_n"))
    return batches.groupBy(*groups).agg(F.sum("_n").alias("n"), F.sum("_mean").alias("loss"))


def bce_loss(df: DataFrame, p: str = "p", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy of the positive class probability."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(binary_cross_entropy(p, label)).alias("loss")
    )


def epoch_history(records: DataFrame, keys: Sequence[str] = ("client", "round", "epoch")) -> DataFrame:
    """Loss and accuracy per epoch from records (n, batches, loss = summed batch means, correct).

    Both divisors are offered: rows and batches.
    """
    return records.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("loss"), F.sum("n")).alias("loss_per_row"),
        F.try_divide(F.sum("loss"), F.sum("batches")).alias("loss_per_batch"),
        F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"),
    )


def weighted_mean(
    df: DataFrame, value: str = "accuracy", weight: str = "n", groups: Sequence[str] = ("round",), out: str | None = None
) -> DataFrame:
    """Row-weighted mean over clients."""
    w = F.col(weight).cast("double")
    return df.groupBy(*groups).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias(out or value))


def server_evaluation(
    df: DataFrame, label: str = "label", pred: str = "pred", loss: str = "loss", batch: str = "batch_id",
    groups: Sequence[str] = ("round",), dataset: str = "dataset",
) -> DataFrame:
    """Per round: plain mean of the data sets' accuracies in %, and the last data set's loss.

    ``losses`` keeps the loss of every data set, in data set order.
    """
    per_batch = df.groupBy(*groups, dataset, batch).agg(
        F.avg(loss).alias("_mean"), F.count("*").alias("_n"), F.sum(is_hit(label, pred)).alias("_hits")
    )
    per_set = per_batch.groupBy(*groups, dataset).agg(
        F.sum("_mean").alias("loss"), (100 * F.sum("_hits") / F.sum("_n")).alias("accuracy_pct")
    )
    return summarise_data_sets(per_set, groups, dataset)


def summarise_data_sets(per_set: DataFrame, groups: Sequence[str] = ("round",), dataset: str = "dataset") -> DataFrame:
    return per_set.groupBy(*groups).agg(
        F.avg("accuracy_pct").alias("mean_accuracy_pct"),
        F.max_by("loss", dataset).alias("loss"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(dataset), F.col("loss")))), lambda s: s["loss"]
        ).alias("losses"),
    )


def repeat_summary(df: DataFrame, keys: Sequence[str] = ("dataset", "algorithm"), value: str = "accuracy") -> DataFrame:
    """Repeats, mean, sample standard deviation, minimum and maximum per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("repeats"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def client_record(
    df: DataFrame, scores: str = "scores", label: str = "label", pred: str = "pred", batch: str = "batch_id",
    groups: Sequence[str] = ("client", "round"),
) -> DataFrame:
    """Per client and round: summed batch-mean loss, rows, and accuracy in % rounded to two decimals."""
    rows = df.withColumn("_loss", cross_entropy(scores, label))
    batches = rows.groupBy(*groups, batch).agg(
        F.avg("_loss").alias("_mean"), F.count("*").alias("_n"), F.sum(is_hit(label, pred)).alias("_hits")
    )
    return batches.groupBy(*groups).agg(
        F.sum("_mean").alias("loss"), F.sum("_n").alias("n"),
        percent(F.sum("_hits") / F.sum("_n")).alias("accuracy"),
    )
