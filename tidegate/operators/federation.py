"""Federated averaging: rounds of local fits, one averaged model, evaluation per client."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import pinned, stable
from .metrics import client_record, epoch_history, summarise_data_sets, weighted_mean
from .networks import Layout, initial_parameters, parameter_table, score_each
from .training import Fit, Shards, fit_history, fit_shards


_FAN = 32                       # partial sums that meet in one task of the middle stage, about
_HELD = 32 << 20                # bytes of sums that a task holds before it passes them on


def _vector_sums(keys: Sequence[str], held: int):
    """Sum (n, w) by key over the batches of a task; ``held`` bytes of sums go out early, in rows of their own.

    With ``held`` 0 a change of key sends its sum, so sorted rows give one row per key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        schema, size = None, 0

        def out():
            names = list(zip(*sums)) if keys else []
            columns = [*names, [s[0] for s in sums.values()], [s[1] for s in sums.values()]]
            arrays = [pa.array(list(c), field.type) for c, field in zip(columns, schema)]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            schema = batch.schema
            groups = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else repeat((), batch.num_rows)
            weights, vectors = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1)
            for group, n, vector in zip(groups, weights, vectors):
                vector = vector.values.to_numpy(zero_copy_only=False)
                if held == 0 and sums and group not in sums:
                    yield out()
                done = sums.get(group)
                if done is None:
                    sums[group] = [n, vector.copy()]
                    size += vector.nbytes
                elif len(done[1]) != len(vector):
                    raise ValueError("parameter arrays differ in length")
                else:
                    done[0] += n
                    done[1] += vector
                if held and size > held:
                    yield out()
                    size = 0
        if sums:
            yield out()

    return run


def average_parameters(params: DataFrame, keys: Sequence[str] = ("round",), weight: str = "n", w: str = "w") -> DataFrame:
    """Elementwise Σ n·w / Σ n over the rows of each key; arrays of unequal length are an error.

    Weighted vectors are summed as Arrow arrays in a tree: in the tasks that
    hold them, then in groups of about ``_FAN`` tasks per key, then per key.
    The shuffles carry one row per task and key, however long the vectors are,
    and a task holds a few sums at a time. Rows without weight or array are left
    out, NULL keys are a group, a key whose weights add up to 0 has NaN.
    """
    keys = list(keys)
    rows = params.where(F.col(weight).isNotNull() & F.col(w).isNotNull()).select(
        *keys, F.col(weight).cast("bigint").alias("_n"),
        F.transform(w, lambda v: v.cast("double") * F.col(weight)).alias("_w"))
    partial = rows.mapInArrow(_vector_sums(keys, _HELD), rows.schema)
    # sums of neighbouring tasks meet first
    near = partial.withColumn("_near", F.floor(F.spark_partition_id() / F.lit(_FAN)))
    middle = near.repartition(*keys, "_near").drop("_near").mapInArrow(_vector_sums(keys, _HELD), rows.schema)
    last = middle.repartition(*keys).sortWithinPartitions(*keys) if keys else middle.repartition(1)
    sums = last.mapInArrow(_vector_sums(keys, 0), rows.schema)
    total = F.col("_n").cast("double")
    return sums.select(*keys, F.col("_n").alias(weight), F.transform(
        "_w", lambda v: F.when(total == 0, F.lit(float("nan"))).otherwise(v / total)).alias(w))


@dataclass(frozen=True)
class FederatedRun:
    history: DataFrame              # client, round, epoch, n, loss_per_row, loss_per_batch, accuracy
    params: DataFrame               # round, client, n, w: the averaged model per round, 0 = start
    models: dict[int, list[float]]


def federate(
    shards: Shards, layout: Layout, fit: Fit, rounds: int = 3, start: Sequence[float] | None = None,
    min_clients: int = 3,
) -> FederatedRun:
    """Rounds of: send the model, fit all clients, average by rows.

    The driver holds one parameter vector per round and the epoch history;
    their sizes depend on layout, rounds, epochs and clients, not on rows.
    """
    if shards.n_clients < min_clients:
        raise ValueError(f"{shards.n_clients} clients, {min_clients} wanted")
    spark = shards.rows.sparkSession
    model = list(start) if start is not None else initial_parameters(layout)
    models, history = {0: model}, None
    params = parameter_table(spark, model)
    for number in range(1, rounds + 1):
        fits = stable(fit_shards(shards, layout, {number: (fit, model)}))
        merged = average_parameters(fits, ["job"]).first()
        model = models[number] = list(merged["w"])
        params = params.unionByName(parameter_table(spark, model, number, None, merged["n"]))
        epochs = pinned(
            epoch_history(fit_history(fits).withColumnRenamed("job", "round"))
        )
        history = epochs if history is None else history.unionByName(epochs)
    return FederatedRun(history, params, models)


def evaluate_rounds(
    holdouts: DataFrame, layout: Layout, models: dict[int, Sequence[float]], features: str = "features",
    label: str = "label", batch: str = "batch_id",
) -> DataFrame:
    """Loss, rows and accuracy of each client's hold-out for every round's model, in one pass."""
    scored = score_each(holdouts.select("client", batch, label, features), layout, models, features)
    return client_record(scored, label=label, batch=batch)


def federated_metrics(records: DataFrame) -> DataFrame:
    """Row-weighted accuracy and loss over clients per round."""
    return weighted_mean(records, "accuracy").join(weighted_mean(records, "loss"), "round")


def server_metrics(records: DataFrame) -> DataFrame:
    """Plain mean accuracy over data sets and the last data set's loss per round."""
    return summarise_data_sets(
        records.select("round", F.col("client").alias("dataset"), "loss", F.col("accuracy").alias("accuracy_pct"))
    )


def logistic_gradient_step(
    df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], bias: float, lr: float,
    groups: Sequence[str] = ("client",),
) -> DataFrame:
    """One full-batch step of logistic regression per client as a single aggregation."""
    z = F.lit(float(bias))
    for c, value in zip(features, weights):
        z = z + F.lit(float(value)) * F.col(c)
    error = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(label).cast("double")
    new = [
        (F.lit(float(value)) - F.lit(lr) * F.avg(error * F.col(c))) for c, value in zip(features, weights)
    ] + [F.lit(float(bias)) - F.lit(lr) * F.avg(error)]
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.array(*new).alias("w"))
