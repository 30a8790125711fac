"""Per-group scalers: fitted on train rows, applied by one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import pinned
from .quantiles import exact_quantiles
from .ranking import attach

# Fixed value: a scale below ten double-precision epsilons counts as constant.
TINY_SCALE = 10 * 2.220446049250313e-16


def _usable(scale: Column) -> Column:
    return F.when(scale.isNull() | F.isnan(scale) | (scale < TINY_SCALE), F.lit(1.0)).otherwise(scale)


def fit_standard(train: DataFrame, columns: Sequence[str], groups: Sequence[str] = ("client",)) -> DataFrame:
    """Mean and population standard deviation in one aggregation; constant columns scale by 1."""
    stats = []
    for c in columns:
        stats += [
            F.avg(c).alias(f"center_{c}"),
            _usable(F.stddev_pop(c)).alias(f"scale_{c}"),
        ]
    return pinned(train.groupBy(*groups).agg(*stats))


def fit_standard_packed(
    train: DataFrame, packed: str, columns: Sequence[str], widen: Callable[[np.ndarray], np.ndarray], group: str = "client",
) -> DataFrame:
    """``fit_standard`` of the columns that ``widen`` makes of an array column's values [row, value], where one aggregation
    of that many columns is too long to be compiled.

    Tasks hold counts, means and squared deviations by group; a NULL value, and
    what is made of it, does not count.
    """
    kind = train.schema[group].dataType.simpleString()
    batch_type = to_arrow_type(train.schema[group].dataType)

    def met(one: tuple, other: tuple) -> tuple:
        (n, mean, square), (m, far, wide) = one, other
        total = np.maximum(n + m, 1)
        gap = far - mean
        return n + m, mean + gap * m / total, square + wide + gap * gap * n * m / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            rows, groups = batch.column(1), batch.column(0).dictionary_encode("encode")
            if not len(rows):
                continue
            flat = rows.flatten()
            values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            x, known = widen(values), None
            if flat.null_count:      # 0 * NULL is NULL
                missing = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, 1.0).reshape(values.shape)
                known = ~np.isnan(widen(missing))
            for number, key in enumerate(groups.dictionary.to_pylist()):
                at = groups.indices.to_numpy() == number
                mine = x[at]
                have = np.ones(mine.shape, bool) if known is None else known[at]
                n = have.sum(axis=0)
                mean = np.where(have, mine, 0.0).sum(axis=0) / np.maximum(n, 1)
                part = n, mean, (np.where(have, mine - mean, 0.0) ** 2).sum(axis=0)
                sums[key] = met(sums[key], part) if key in sums else part
        held = zip(*sums.values()) if sums else ((), (), ())
        kinds = pa.int64(), pa.float64(), pa.float64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), batch_type), *(pa.array(list(c), pa.list_(t)) for c, t in zip(held, kinds))],
            names=[group, "n", "mean", "square"])

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for parts in zip(*(table.column(c) for c in ("n", "mean", "square"))):
            part = tuple(p.values.to_numpy() for p in parts)
            total = part if total is None else met(total, part)
        n, mean, square = total
        some = n > 0
        return pa.table({group: table.column(group)[:1], **{name: pa.array([pa.array(v, pa.float64(), mask=~some)], pa.list_(pa.float64()))
                                                           for name, v in (("center", mean), ("scale", np.sqrt(square / np.maximum(n, 1))))}})

    parts = train.select(group, F.col(packed).cast("array<double>").alias("_packed")).mapInArrow(
        run, f"{group} {kind}, n array<bigint>, mean array<double>, square array<double>")
    found = parts.groupBy(group).applyInArrow(merged, f"{group} {kind}, center array<double>, scale array<double>")
    return pinned(found.select(group, *[v for k, c in enumerate(columns) for v in (
        F.col("center")[k].alias(f"center_{c}"), _usable(F.col("scale")[k]).alias(f"scale_{c}"))]))


def fit_robust(
    train: DataFrame,
    columns: Sequence[str],
    groups: Sequence[str] = ("client",),
    approximate: bool = False,
    **limits,
) -> DataFrame:
    """Median and interquartile range, exact by default; constant columns scale by 1."""
    groups = list(groups)
    probs = [0.25, 0.5, 0.75]
    if approximate:
        wide = train.groupBy(*groups).agg(
            *[F.approx_percentile(c, F.array(*map(F.lit, probs)), 10_000).alias(c) for c in columns]
        )
        quartile = {(c, i): F.col(c)[i] for c in columns for i in range(3)}
    else:
        quantiles = exact_quantiles(train, columns, probs, groups, **limits)
        wide = quantiles.groupBy(*groups).agg(*[
            F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value"))).alias(f"q{i}_{c}")
            for c in columns for i, p in enumerate(probs)
        ])
        quartile = {(c, i): F.col(f"q{i}_{c}") for c in columns for i in range(3)}
    out = []
    for c in columns:
        out += [
            quartile[c, 1].cast("double").alias(f"center_{c}"),
            _usable((quartile[c, 2] - quartile[c, 0]).cast("double")).alias(f"scale_{c}"),
        ]
    return pinned(wide.select(*groups, *out))


def scale(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], groups: Sequence[str] = ("client",)
) -> DataFrame:
    """(x - center) / scale with each group's own statistics."""
    wanted = set(columns)
    joined = attach(df, stats, groups)
    return joined.select(*[
        ((F.col(c) - F.col(f"center_{c}")) / F.col(f"scale_{c}")).alias(c) if c in wanted else F.col(c)
        for c in df.columns
    ])
