"""Sources and sinks (O01-O07) and the flagship query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from ..functions.columns import digest, draw_unit
from ..operators import cleaning, metrics, networks, sampling, scaling
from ..operators.federation import average_parameters
from ..session import scratch_path
from ..sources import flows as src, sinks
from .cleaning_queries import finite_sql
from .registry import register
from .views import DIRTY_SQL, FEATURES, FLOWS_SQL, KEY, SHARE, SPLIT_SQL, dirty_flows, flows

# Weights of the fixed linear rule on standardised features, in FEATURES order.
RULE = [0.05, 1.0, -0.2, 0.0]
RULE_CUT = 0.4

_RULE_SQL = " + ".join(
    f"{w} * (t.{c} - m_{c}) / CASE WHEN s_{c} < 1e-14 THEN 1 ELSE s_{c} END" for c, w in zip(FEATURES, RULE)
)


@register("flagship_slice_accuracy", f"""WITH {SPLIT_SQL},
stats AS (SELECT client, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)}
          FROM split WHERE NOT is_test GROUP BY client),
scored AS (SELECT t.client, t.attack, CAST({_RULE_SQL} > {RULE_CUT} AS BIGINT) AS pred
           FROM split t JOIN stats USING (client) WHERE is_test),
per_client AS (SELECT client, count(*) AS n, avg(CAST(attack = pred AS DOUBLE)) AS accuracy FROM scored GROUP BY client)
SELECT client, n, round(accuracy, 6) AS accuracy FROM per_client
UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(sum(n * accuracy) / sum(n), 6) FROM per_client""")
def slice_accuracy(spark, sf_dir):
    """Split per client, scale with train statistics, score, accuracy per client and weighted over clients."""
    prepared = cleaning.repair_infinities(cleaning.binarise_label(flows(spark, sf_dir)), FEATURES)
    marked = sampling.split_by_share(prepared, SHARE, KEY)
    stats = scaling.fit_standard(marked.where(~F.col("is_test")), FEATURES)
    test = scaling.scale(marked.where("is_test"), stats, FEATURES)
    margin = sum((F.lit(w) * F.col(c) for c, w in zip(FEATURES[1:], RULE[1:])), F.lit(RULE[0]) * F.col(FEATURES[0]))
    scored = test.withColumn("pred", (margin > RULE_CUT).cast("bigint"))
    per_client = metrics.accuracy(scored, "attack", "pred", ["client"])
    total = metrics.accuracy(scored, "attack", "pred").withColumn("client", F.lit(None).cast("int"))
    return per_client.unionByName(total).select("client", "n", F.round("accuracy", 6).alias("accuracy"))


def _through_csv(spark, df, schema):
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    return src.read_flows(spark, path, schema)


@register("o01_csv_scan", "WITH " + DIRTY_SQL + "\nSELECT client, count(*) AS n, " + ", ".join(
    f"count({c}) AS n_{c}, round(sum({finite_sql(c)}), 2) AS {c}" for c in FEATURES
) + """, count(*) FILTER (WHERE isinf(price)) AS n_inf, count(*) FILTER (WHERE isnan(price)) AS n_nan,
count(*) FILTER (WHERE "Label" IS NULL) AS unlabelled FROM dirty GROUP BY client""")
def csv_scan(spark, sf_dir):
    """Dirty flows through a CSV file with header: gaps, NaN and infinities must survive."""
    d = dirty_flows(spark, sf_dir).select("client", *FEATURES, "Label")
    back = _through_csv(spark, d, d.schema)
    clean = [F.round(F.sum(x), 2) for x in (
        F.when((F.col(c) < float("inf")) & (F.col(c) > float("-inf")), F.col(c)).otherwise(0.0) for c in FEATURES
    )]
    return back.groupBy("client").agg(
        F.count("*").alias("n"),
        *[x for c, total in zip(FEATURES, clean) for x in (F.count(c).alias(f"n_{c}"), total.alias(c))],
        F.count_if(F.col("price") == float("inf")).alias("n_inf"), F.count_if(F.isnan("price")).alias("n_nan"),
        F.count_if(F.col("Label").isNull()).alias("unlabelled"),
    )


@register("o02_client_catalog", "WITH " + FLOWS_SQL + """
SELECT client, count(*) AS n, round(sum(price), 2) AS price FROM flows WHERE client <> 2 GROUP BY client""")
def client_catalog(spark, sf_dir):
    """One file per client, read back as one table; two of the three clients asked for."""
    folder = scratch_path(spark, "clients")
    f = flows(spark, sf_dir).select("client", *FEATURES)
    src.write_by_client(f, folder)
    paths = src.catalog(folder, {i: f"client={i}" for i in (1, 2, 3)})
    both = src.read_catalog(spark, paths, f.drop("client").schema, "parquet", clients=[1, 3])
    return both.groupBy("client").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@register("o02_partition_pruned_scan", "WITH " + FLOWS_SQL + """
SELECT client, count(*) AS n, round(sum(price), 2) AS price FROM flows WHERE client = 2 GROUP BY client""")
def partition_pruned_scan(spark, sf_dir):
    path = scratch_path(spark, "by-client")
    src.write_by_client(flows(spark, sf_dir).select("client", "price"), path)
    one = spark.read.parquet(path).where(F.col("client") == 2)
    return one.groupBy("client").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@register("o03_positional_test_set", "WITH " + FLOWS_SQL + """
SELECT attack AS label, count(*) AS n, CAST(4 AS INT) AS width,
       round(sum(quantity + price + discount + tax), 2) AS total
FROM flows GROUP BY attack""")
def positional_test_set(spark, sf_dir):
    t = src.positional_test_set(flows(spark, sf_dir).select(*FEATURES, "attack"), width=4)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return t.groupBy("label").agg(
        F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.round(F.sum(total), 2).alias("total")
    )


@register("o04_csv_sink", "WITH " + SPLIT_SQL + """
SELECT client, quantity, price, discount, tax, attack FROM split WHERE is_test""")
def csv_sink(spark, sf_dir):
    """Hold-outs as CSV without an index, the label as last column."""
    test = sampling.train_test(flows(spark, sf_dir), SHARE, KEY)[1].select("client", *FEATURES, "attack")
    return _through_csv(spark, test, test.schema)


def rule_repeats(spark, sf_dir, repeats=10):
    """Accuracy in % of two fixed rules per client and repeat, each repeat on its own random fifth."""
    f = flows(spark, sf_dir).select(
        "client", "flow_key", "attack", "quantity", "price",
        F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"),
    ).where(draw_unit(digest("repeat", "repeat", "flow_key")) < SHARE)
    rules = F.explode(F.array(
        F.struct(F.lit("price").alias("algorithm"), (F.col("price") > 52000).cast("bigint").alias("pred")),
        F.struct(F.lit("quantity").alias("algorithm"), (F.col("quantity") > 25).cast("bigint").alias("pred")),
    ))
    scored = f.select(F.col("client").alias("dataset"), "repeat", "attack", rules.alias("_r")).select("*", "_r.*")
    return metrics.accuracy(scored, "attack", "pred", ["dataset", "algorithm", "repeat"]).withColumn(
        "accuracy", 100 * F.col("accuracy")
    )


REPEATS_SQL = FLOWS_SQL + """,
repeats AS (
  SELECT client AS dataset, algorithm, CAST(r AS INT) AS repeat, 100 * avg(CAST(attack = pred AS DOUBLE)) AS accuracy
  FROM (SELECT client, r, attack, algorithm, CASE algorithm WHEN 'price' THEN CAST(price > 52000 AS BIGINT)
                                             ELSE CAST(quantity > 25 AS BIGINT) END AS pred
        FROM flows, range(1, 11) t(r), (VALUES ('price'), ('quantity')) a(algorithm)
        WHERE CAST(('0x' || substr(md5('repeat:' || r || ':' || flow_key), 1, 15)) AS BIGINT)
              / 1152921504606846976.0 < 0.2)
  GROUP BY ALL)"""


@register("o05_accuracy_report", "WITH " + REPEATS_SQL + """
SELECT dataset, algorithm, repeat, printf('%.2f', accuracy) AS accuracy FROM repeats""")
def accuracy_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_accuracy_report(rule_repeats(spark, sf_dir), path)
    return spark.read.option("header", True).schema(
        "repeat int, accuracy string, dataset int, algorithm string"
    ).csv(path)


_MEANS_SQL = "list_transform([{}], lambda v: round(v, 6))".format(", ".join(f"avg({c})" for c in FEATURES))


def client_means(spark, sf_dir):
    """Feature means per client in the form of local parameters, for three rounds."""
    means = flows(spark, sf_dir).groupBy("client").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in FEATURES]).alias("w")
    )
    rounds = F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("round")
    scaled = F.transform("w", lambda v: v * F.col("round"))
    return means.select(rounds, "client", "n", "w").withColumn("w", scaled)


@register("o06_parameter_checkpoint", "WITH " + FLOWS_SQL + """,
cells AS (SELECT client, count(*) AS n, """ + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + """
          FROM flows GROUP BY client)
SELECT CAST(r AS INT) AS round, CAST(sum(n) AS BIGINT) AS n, """ + ", ".join(
    f"round(sum(n * r * {c}) / sum(n), 6) AS {c}" for c in FEATURES) + """
FROM cells, range(2, 4) t(r) GROUP BY r""")
def parameter_checkpoint(spark, sf_dir):
    """Averaged parameters stored per round; rounds 2 and 3 read back through the strict loader."""
    path = scratch_path(spark, "params")
    layout = networks.Layout("means", (1, 2))
    merged = average_parameters(client_means(spark, sf_dir))
    sinks.save_parameters(merged, path)
    last = sinks.load_parameters(spark, path, layout)
    stored = spark.read.parquet(path).where(F.col("round") >= 2)
    assert len(last) == layout.n_parameters
    return stored.select(
        "round", "n", *[F.round(F.col("w")[i], 6).alias(c) for i, c in enumerate(FEATURES)]
    )


@register("o63_user_functions", "WITH " + FLOWS_SQL + """
SELECT client, count(*) AS n, round(avg(1 / (1 + exp(-(price / 50000 - 1)))), 6) AS mean_score,
       round(sum(count(*) * avg(price)) OVER () / sum(count(*)) OVER (), 4) AS overall_price
FROM flows GROUP BY client""")
def user_functions(spark, sf_dir):
    """The three kinds of user function: rows to scores, group to rows, table to table.

    Groups are a client's rows of one part, so that no client is ever whole in one task.
    """
    parts = max(1, spark.sparkContext.defaultParallelism * 4)

    @F.pandas_udf("double")
    def score(price: pd.Series) -> pd.Series:
        return 1.0 / (1.0 + np.exp(-(price / 50000 - 1)))

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame({
            "client": [first["client"]], "n": [len(rows)], "score": [rows["score"].sum()], "price": [rows["price"].sum()]})

    def overall(df):
        everyone = Window.partitionBy()
        return df.withColumn("overall_price", F.sum("price").over(everyone) / F.sum("n").over(everyone))

    scored = flows(spark, sf_dir).select(
        "client", "price", score("price").alias("score"), F.pmod(F.xxhash64("flow_key"), F.lit(parts)).alias("part"))
    sums = scored.groupBy("client", "part").applyInPandas(summary, "client int, n bigint, score double, price double")
    per_client = sums.groupBy("client").agg(F.sum("n").alias("n"), F.sum("score").alias("score"), F.sum("price").alias("price"))
    return per_client.transform(overall).select(
        "client", "n", F.round(F.col("score") / F.col("n"), 6).alias("mean_score"),
        F.round("overall_price", 4).alias("overall_price"),
    )
