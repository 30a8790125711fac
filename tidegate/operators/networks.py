"""Perceptron layouts, initial parameters and scoring.

A model is a layout plus one flat parameter vector: per layer the weights row
by row, then the biases. Its length depends on the layout only, never on data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import DRAW_DIGITS, DRAW_RANGE, argmax, softmax

MAX_PARAMETERS = 5_000_000     # 40 MB of doubles, the most that is sent to executors
INLINE_PARAMETERS = 200        # up to here a model is one generated Column expression


@dataclass(frozen=True)
class Layout:
    """``sizes`` from input to output, ``head`` on top of the last layer, ``spare`` unused hidden layers."""

    name: str
    sizes: tuple[int, ...]
    head: str = "logits"            # logits | sigmoid | softmax
    dropout: float = 0.0            # after the hidden activations, in training only
    spare: tuple[int, ...] = field(default=())   # layers carried and averaged but not used, after layer 1

    def with_input(self, width: int) -> "Layout":
        return replace(self, sizes=(width, *self.sizes[1:]))

    def shapes(self) -> list[tuple[int, int, bool]]:
        """(outputs, inputs, used) of every layer in parameter order."""
        used = [(o, i, True) for i, o in zip(self.sizes, self.sizes[1:])]
        return used[:1] + [(h, h, False) for h in self.spare] + used[1:]

    @property
    def n_parameters(self) -> int:
        return sum(o * i + o for o, i, _ in self.shapes())

    def unpack(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views (weights, biases) of the used layers."""
        if len(flat) != self.n_parameters:
            raise ValueError(f"{self.name}: {len(flat)} parameters, layout has {self.n_parameters}")
        layers, at = [], 0
        for o, i, used in self.shapes():
            w, b = flat[at:at + o * i].reshape(o, i), flat[at + o * i:at + o * i + o]
            at += o * i + o
            if used:
                layers.append((w, b))
        return layers


# Layer sizes and heads of the five model variants.
VARIANTS = {
    "v1": Layout("v1", (49, 32, 2), head="sigmoid"),
    "v2": Layout("v2", (49, 32, 32, 32, 32, 2)),
    "v3": Layout("v3", (78, 16, 2), head="softmax", dropout=0.4, spare=(16,)),
    "v4": Layout("v4", (49,) + (32,) * 11 + (32,)),
    "v5": Layout("v5", (78, 128, 128, 2), head="softmax"),
}


def initial_parameters(layout: Layout, seed="init") -> list[float]:
    """Uniform in ±1/sqrt(inputs) per layer, drawn from md5 of ``seed:position``."""
    flat, at = [], 0
    for o, i, _ in layout.shapes():
        bound = 1.0 / i**0.5
        for pos in range(at, at + o * i + o):
            text = hashlib.md5(f"{seed}:{pos}".encode()).hexdigest()
            flat.append((2.0 * (int(text[:DRAW_DIGITS], 16) / DRAW_RANGE) - 1.0) * bound)
        at += o * i + o
    return flat


def parameter_table(
    spark: SparkSession, flat: Sequence[float], round_: int = 0, client: int | None = None, n: int | None = None
) -> DataFrame:
    """One row (round, client, n, w)."""
    return spark.createDataFrame(
        pa.table({
            "round": pa.array([round_], pa.int32()),
            "client": pa.array([client], pa.int32()),
            "n": pa.array([n], pa.int64()),
            "w": pa.array([list(map(float, flat))], pa.list_(pa.float64())),
        })
    )


def forward(layout: Layout, layers, x: np.ndarray) -> np.ndarray:
    """Scores of a block of rows."""
    for w, b in layers[:-1]:
        x = np.maximum(x @ w.T + b, 0.0)
    w, b = layers[-1]
    z = x @ w.T + b
    if layout.head == "sigmoid":
        return 1.0 / (1.0 + np.exp(-z))
    if layout.head == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return z


def block(features: pa.ListArray, width: int) -> np.ndarray:
    """Rows × width matrix over the Arrow buffer of a gap-free list column."""
    values = features.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(features) * width:
        raise ValueError(f"features are not {width} wide")
    return values.reshape(len(features), width)


def _inline_scores(layout: Layout, flat: np.ndarray, x: Sequence[Column]) -> Column:
    """The network as one generated expression over feature columns."""
    layers = layout.unpack(flat)
    values = list(x)
    for depth, (w, b) in enumerate(layers):
        outs = []
        for row, bias in zip(w.tolist(), b.tolist()):
            total = F.lit(bias)
            for weight, value in zip(row, values):
                total = total + F.lit(weight) * value
            outs.append(F.greatest(total, F.lit(0.0)) if depth < len(layers) - 1 else total)
        values = outs
    if layout.head == "sigmoid":
        return F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) for v in values])
    return F.array(*values)


def score(
    df: DataFrame, layout: Layout, flat: Sequence[float], features: str | Sequence[str] = "features",
    scores: str = "scores", pred: str = "pred",
) -> DataFrame:
    """Add class scores and the predicted class.

    ``features`` is an array column or a list of numeric columns. A small model
    over numeric columns with one hidden layer stays inside code generation;
    other models run as one Arrow function per batch of rows.
    """
    flat = np.asarray(flat, dtype="float64")
    if layout.n_parameters > MAX_PARAMETERS:
        raise ValueError(f"{layout.name} has more than {MAX_PARAMETERS} parameters")
    layout.unpack(flat)
    if isinstance(features, str):
        packed = F.col(features).cast("array<double>")
    else:
        if len(features) != layout.sizes[0]:
            raise ValueError(f"{len(features)} features, model takes {layout.sizes[0]}")
        packed = F.array(*[F.col(c).cast("double") for c in features])
        if len(layout.sizes) <= 3 and layout.n_parameters <= INLINE_PARAMETERS:
            out = df.withColumn(scores, _inline_scores(layout, flat, [F.col(c).cast("double") for c in features]))
            if layout.head == "softmax":
                out = out.withColumn(scores, softmax(scores))
            return out.withColumn(pred, argmax(scores))
    width, sent = layout.sizes[0], df.sparkSession.sparkContext.broadcast(flat)

    @F.arrow_udf("array<double>")
    def network(rows: pa.Array) -> pa.Array:
        return _list_array(forward(layout, layout.unpack(sent.value), block(rows, width)))

    return df.withColumn(scores, network(packed)).withColumn(pred, argmax(scores))


def in_parts(jobs: Sequence, size: int) -> list[list]:
    """Jobs of ``size`` values each in parts that may be broadcast together."""
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} values are more than the {MAX_PARAMETERS} that may be broadcast")
    step = MAX_PARAMETERS // max(1, size)
    return [list(jobs[at:at + step]) for at in range(0, len(jobs), step)]


def _list_array(z: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype="int32"))
    return pa.ListArray.from_arrays(ends, pa.array(z.ravel()))


def score_each(
    df: DataFrame, layout: Layout, models: dict[int, Sequence[float]], features: str = "features",
    model: str = "round", scores: str = "scores", pred: str = "pred",
) -> DataFrame:
    """Every row with every model (``model`` holds its number).

    One pass over the rows for as many models as ``MAX_PARAMETERS`` values hold.
    """
    numbers = sorted(models)
    parts = in_parts(numbers, layout.n_parameters)
    if len(parts) > 1:
        scored = [score_each(df, layout, {i: models[i] for i in part}, features, model, scores, pred) for part in parts]
        return reduce(DataFrame.unionByName, scored)
    stacked = np.array([models[i] for i in numbers], dtype="float64")
    width, outputs = layout.sizes[0], layout.sizes[-1]
    sent = df.sparkSession.sparkContext.broadcast(stacked)

    @F.arrow_udf("array<array<double>>")
    def networks(rows: pa.Array) -> pa.Array:
        x = block(rows, width)
        z = np.stack([forward(layout, layout.unpack(flat), x) for flat in sent.value], axis=1)
        inner = _list_array(z.reshape(-1, outputs))
        ends = pa.array(np.arange(0, len(inner) + 1, len(numbers), dtype="int32"))
        return pa.ListArray.from_arrays(ends, inner)

    keep = [F.col(c) for c in df.columns if c != features]
    return (
        df.select(*keep, F.posexplode(networks(F.col(features).cast("array<double>"))).alias("_at", scores))
        .withColumn(model, F.element_at(F.array(*[F.lit(i) for i in numbers]), F.col("_at") + 1).cast("int"))
        .drop("_at")
        .withColumn(pred, argmax(scores))
    )
