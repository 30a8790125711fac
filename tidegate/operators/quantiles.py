"""Exact quantiles of many columns per group, without holding a group in one buffer.

Small groups use the built-in ``percentile``. Larger ones are narrowed: a
bounded sketch brackets each quantile, one pass counts the rows below and
inside the bracket, and only rows inside a bracket (under 0.1 % of the table per
quantile) are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import SMALL_CELLS, largest, pinned, stable
from .ranking import attach

PERCENTILE_CELLS = 4_000_000  # values (rows × columns) of one group the built-in buffers may hold
SKETCH = 10_000               # approx_percentile accuracy: rank error n / SKETCH
MARGIN = 3.0 / SKETCH
COLUMNS_PER_PASS = 26         # keeps the counting aggregation small enough to compile
FEW_ROWS = 20_000             # below, the bracket is the whole range
WINDOW_ROWS = 2_000_000       # distinct values one window partition may order
SPLITS = 1_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    groups: Sequence[str] = (),
    direct_rows: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Long table (groups, column, prob, value) with linear interpolation between ranks."""
    groups, columns, probs = list(groups), list(columns), [float(p) for p in probs]
    if direct_rows is None:
        direct_rows = PERCENTILE_CELLS // len(columns)
    if largest(pinned(df.groupBy(*groups).count()), "count") <= direct_rows:
        wide = df.groupBy(*groups).agg(
            *[F.percentile(F.col(c), F.array(*map(F.lit, probs))).alias(c) for c in columns]
        )
        rows = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.col(c)[i].alias("value"))
            for c in columns for i, p in enumerate(probs)
        ]))
        return pinned(wide.select(*groups, rows.alias("_r")).select(*groups, "_r.*"))
    parts = [
        _narrowed(df, columns[i:i + COLUMNS_PER_PASS], probs, groups, window_rows)
        for i in range(0, len(columns), COLUMNS_PER_PASS)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return pinned(out)


def _narrowed(df, columns, probs, groups, window_rows):
    """Quantiles by brackets; a rank outside its bracket, against the sketch's promise, is sought in the whole range."""
    found = pinned(_bracketed(df, columns, probs, groups, window_rows, whole=False))
    missed = found.where(F.col("value").isNull())
    if missed.isEmpty():
        return found
    again = [r["column"] for r in missed.select("column").distinct().collect()]
    rest = _bracketed(df, again, probs, groups, window_rows, whole=True)
    return found.where(~F.col("column").isin(again)).unionByName(rest)


def _bracketed(df, columns, probs, groups, window_rows, whole):
    targets = [(c, p) for c in columns for p in probs]
    edges = [e for p in probs for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]

    sketch = []
    for c in columns:
        sketch += [
            F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
            F.approx_percentile(c, F.array(*map(F.lit, edges)), SKETCH).alias(f"e_{c}"),
        ]
    wide = pinned(df.groupBy(*groups).agg(*sketch))

    # the outermost edges are the true extremes, so small shares stay bracketed
    brackets = []
    for c, p in targets:
        i = probs.index(p)
        few = F.lit(whole) | (F.col(f"n_{c}") < FEW_ROWS)
        low = F.when(few | F.lit(p - MARGIN <= 0), F.col(f"min_{c}")).otherwise(F.col(f"e_{c}")[2 * i])
        high = F.when(few | F.lit(p + MARGIN >= 1), F.col(f"max_{c}")).otherwise(F.col(f"e_{c}")[2 * i + 1])
        brackets.append((low.alias(f"lo_{c}_{i}"), high.alias(f"hi_{c}_{i}")))
    limits = pinned(wide.select(
        *groups, *[F.col(f"n_{c}") for c in columns], *[x for pair in brackets for x in pair]
    ))
    value_columns = df.select(*groups, *columns)
    bounded = attach(value_columns, limits, groups)

    def inside(c, i):
        return (F.col(c) >= F.col(f"lo_{c}_{i}")) & (F.col(c) <= F.col(f"hi_{c}_{i}"))

    index = [(c, probs.index(p)) for c, p in targets]
    counted = bounded.groupBy(*groups).agg(*[
        F.sum(F.when(F.col(c) < F.col(f"lo_{c}_{i}"), 1).otherwise(0)).alias(f"b_{c}_{i}") for c, i in index
    ])
    facts = pinned(
        attach(counted, limits.select(*groups, *[f"n_{c}" for c in columns]), groups)
        .select(*groups, F.explode(F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.lit(probs[i]).alias("prob"),
                F.col(f"b_{c}_{i}").alias("below"), F.col(f"n_{c}").alias("n"),
            ) for c, i in index
        ])).alias("_f")).select(*groups, "_f.*")
    ) if groups else _single_facts(counted, limits, columns, index, probs)
    facts = pinned(
        facts.withColumn("_pos", F.col("prob") * (F.col("n") - 1))
        .withColumn("k0", F.floor("_pos").cast("bigint") - F.col("below"))
        .withColumn("k1", F.ceil("_pos").cast("bigint") - F.col("below"))
        .withColumn("frac", F.col("_pos") - F.floor("_pos"))
        .select(*groups, "column", "prob", "k0", "k1", "frac")
    )
    candidates = (
        bounded.select(*groups, F.explode(F.filter(
            F.array(*[
                F.when(inside(c, i), F.struct(
                    F.lit(c).alias("column"), F.lit(probs[i]).alias("prob"), F.col(c).cast("double").alias("value")
                )) for c, i in index
            ]),
            lambda s: s.isNotNull(),
        )).alias("_s"))
        .select(*groups, "_s.*")
        .groupBy(*groups, "column", "prob", "value")
        .agg(F.count("*").alias("c"))
    )
    return _select_ranks(stable(candidates), facts, groups, window_rows)


def _single_facts(counted, limits, columns, index, probs):
    merged = attach(counted, limits.select(*[f"n_{c}" for c in columns]), [])
    return pinned(merged.select(F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(probs[i]).alias("prob"),
            F.col(f"b_{c}_{i}").alias("below"), F.col(f"n_{c}").alias("n"),
        ) for c, i in index
    ])).alias("_f")).select("_f.*"))


def _select_ranks(candidates, facts, groups, window_rows):
    """Values at the 0-based ranks k0 and k1 of counted values, narrowed until they fit a window."""
    keys = [*groups, "column", "prob"]
    before = None
    while True:
        most = largest(pinned(candidates.groupBy(*keys).agg(F.count("*").alias("_d"))), "_d")
        if most <= window_rows or most == before:
            break
        before = most
        # equal steps over the distinct values; the true minimum and maximum close the list
        steps = [i / SPLITS for i in range(1, SPLITS)]
        cuts = pinned(
            candidates.groupBy(*keys).agg(F.concat(
                F.array(F.min("value")),
                F.approx_percentile("value", F.array(*map(F.lit, steps)), SKETCH),
                F.array(F.max("value")),
            ).alias("_cuts")),
            max_rows=SMALL_CELLS // SPLITS,
        )
        spans = attach(candidates, cuts, keys).withColumn(
            "_span", F.size(F.filter("_cuts", lambda e: e < F.col("value")))
        )
        per_span = spans.groupBy(*keys, "_span").agg(F.sum("c").alias("_w"))
        running = per_span.withColumn(
            "_end", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_span"))
        )
        chosen = pinned(
            attach(running, facts, keys)
            .where((F.col("_end") > F.col("k0")) & (F.col("_end") - F.col("_w") <= F.col("k1")))
            .groupBy(*keys)
            .agg(
                F.min("_span").alias("_first"), F.max("_span").alias("_last"),
                F.min(F.col("_end") - F.col("_w")).alias("_skip"),
            )
        )
        candidates = stable(
            attach(spans, chosen, keys)
            .where(F.col("_span").between(F.col("_first"), F.col("_last")))
            .select(*keys, "value", "c")
        )
        facts = pinned(
            attach(facts, chosen, keys)
            .withColumn("k0", F.col("k0") - F.col("_skip"))
            .withColumn("k1", F.col("k1") - F.col("_skip"))
            .select(*keys, "k0", "k1", "frac")
        )
    running = candidates.withColumn("_end", F.sum("c").over(Window.partitionBy(*keys).orderBy("value")))
    placed = attach(running, facts, keys)

    def at(rank):
        return F.max(F.when((F.col("_end") > F.col(rank)) & (F.col("_end") - F.col("c") <= F.col(rank)), F.col("value")))

    # a target without candidates keeps its row, with a NULL value
    picked = placed.groupBy(*keys, "frac").agg(at("k0").alias("_v0"), at("k1").alias("_v1"))
    return attach(facts.select(*keys), picked, keys, "left").select(
        *keys, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("frac")).alias("value")
    )
