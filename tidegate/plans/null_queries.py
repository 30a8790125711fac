"""Flows without a client: a group of their own that no operator may lose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sampling, scaling
from .registry import register
from .views import FEATURES, FLOWS_SQL, KEY, SHARE, flows


def anonymous(spark, sf_dir):
    """Flows, every seventh by its quantity without a client, every fifth by its part of them without a label."""
    f = flows(spark, sf_dir)
    return f.withColumns({
        "client": F.when(F.col("quantity") % 7 != 0, F.col("client")),
        "attack": F.when(F.col("quantity") % 5 != 0, F.col("attack")),
    })


NULLS_SQL = FLOWS_SQL + """,
anonymous AS (SELECT CASE WHEN quantity % 7 <> 0 THEN client END AS client, flow_key, quantity, price, discount, tax,
                     CASE WHEN quantity % 5 <> 0 THEN attack END AS attack FROM flows)"""


def _split_sql(share: float) -> str:
    return "WITH " + NULLS_SQL + f""",
split AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY md5('split:' || flow_key))
                 <= ceil(count(*) OVER (PARTITION BY client) * {share}::DOUBLE) AS is_test FROM anonymous)
SELECT client, count(*) AS n, CAST(count(*) FILTER (is_test) AS BIGINT) AS n_test, round(sum(price) FILTER (is_test), 2) AS price
FROM split GROUP BY client"""


def _split(share, spark, sf_dir):
    marked = sampling.split_by_share(anonymous(spark, sf_dir), share, KEY)
    return marked.groupBy("client").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("n_test"),
        F.round(F.sum(F.when(F.col("is_test"), F.col("price"))), 2).alias("price"))


@register("o17_split_null_clients", _split_sql(SHARE))
def split_null_clients(spark, sf_dir):
    return _split(SHARE, spark, sf_dir)


@register("o17_split_nothing", _split_sql(0.0))
def split_nothing(spark, sf_dir):
    """Share 0: every row is a train row."""
    return _split(0.0, spark, sf_dir)


@register("o17_split_everything", _split_sql(1.0))
def split_everything(spark, sf_dir):
    """Share 1: every row is a test row."""
    return _split(1.0, spark, sf_dir)


@register("o18_shuffle_null_clients", "WITH " + NULLS_SQL + """,
ranked AS (SELECT client, price, row_number() OVER (PARTITION BY client ORDER BY md5('shuffle:0:' || flow_key)) - 1 AS row_idx FROM anonymous)
SELECT client, count(*) AS n, CAST(sum(row_idx) AS BIGINT) AS places,
       round(sum(CASE WHEN row_idx < 100 THEN price END), 2) AS first_hundred FROM ranked GROUP BY client""")
def shuffle_null_clients(spark, sf_dir):
    ranked = sampling.shuffle_rows(anonymous(spark, sf_dir), KEY)
    return ranked.groupBy("client").agg(
        F.count("*").alias("n"), F.sum("row_idx").alias("places"),
        F.round(F.sum(F.when(F.col("row_idx") < 100, F.col("price"))), 2).alias("first_hundred"))


@register("o24_scale_null_clients", "WITH " + NULLS_SQL + """,
stats AS (SELECT client, """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + """
          FROM anonymous GROUP BY client)
SELECT a.client, count(*) AS n, """ + ", ".join(
    f"round(max(({c} - m_{c}) / CASE WHEN s_{c} < 1e-14 THEN 1 ELSE s_{c} END), 6) AS {c}" for c in FEATURES) + """
FROM anonymous a JOIN stats s ON a.client IS NOT DISTINCT FROM s.client GROUP BY a.client""")
def scale_null_clients(spark, sf_dir):
    rows = anonymous(spark, sf_dir)
    scaled = scaling.scale(rows, scaling.fit_standard(rows, FEATURES), FEATURES)
    return scaled.groupBy("client").agg(
        F.count("*").alias("n"), *[F.round(F.max(c), 6).alias(c) for c in FEATURES])


@register("o26_accuracy_null_labels", "WITH " + NULLS_SQL + """
SELECT client, count(*) AS n, round(avg(CASE WHEN attack = CAST(price > 30000 AS INT) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM anonymous GROUP BY client""")
def accuracy_null_labels(spark, sf_dir):
    """Rows without a label are never hits, not even where the prediction is missing too."""
    rows = anonymous(spark, sf_dir).withColumn("pred", F.when(F.col("attack").isNotNull(), (F.col("price") > 30000).cast("bigint")))
    out = metrics.accuracy(rows, "attack", "pred", ["client"])
    return out.withColumn("accuracy", F.round("accuracy", 6))
