"""Views of the driver's tables in the roles of flow tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import digest, draw_int

FEATURES = ["quantity", "price", "discount", "tax"]
KEY = ["flow_key"]
SHARE = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as flow table: three clients, four features, a text label, a learnable 0/1 label."""
    return flows_from(table(spark, sf_dir, "lineitem"))


def flows_from(l: DataFrame) -> DataFrame:
    return l.select(
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("client"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date"))
        ).alias("flow_key"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise(F.col("l_returnflag")).alias("Label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 50000).cast("bigint").alias("attack"),
    )


FLOWS_SQL = """flows AS (
  SELECT CAST(l_suppkey % 3 + 1 AS INT) AS client,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS flow_key,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag END AS "Label",
         CAST(l_extendedprice * (1 - l_discount) > 50000 AS BIGINT) AS attack
  FROM lineitem)"""


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with gaps, NaN, infinities and missing labels set by a hash of the key."""
    dirt = draw_int(digest("dirt", "flow_key")) % 16
    f = flows(spark, sf_dir).withColumn("_d", dirt)
    return f.select(
        "client", "flow_key",
        F.when(F.col("_d") == 0, None).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("_d") == 1, F.lit(float("nan"))).when(F.col("_d") == 2, F.lit(float("inf")))
        .otherwise(F.col("price")).alias("price"),
        F.when(F.col("_d") == 3, F.lit(float("-inf"))).otherwise(F.col("discount")).alias("discount"),
        F.when(F.col("_d") == 4, None).otherwise(F.col("tax")).alias("tax"),
        F.when(F.col("_d") == 5, None).otherwise(F.col("Label")).alias("Label"),
    )


def draw_sql(text: str) -> str:
    """60-bit integer of an md5, as ``draw_int(digest(...))``."""
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def unit_sql(text: str) -> str:
    return f"({draw_sql(text)} / 1152921504606846976.0)"


DIRTY_SQL = FLOWS_SQL + f""",
marked AS (SELECT *, {draw_sql("'dirt:' || flow_key")} % 16 AS d FROM flows),
dirty AS (
  SELECT client, flow_key,
         CASE WHEN d = 0 THEN NULL ELSE quantity END AS quantity,
         CASE WHEN d = 1 THEN 'NaN'::DOUBLE WHEN d = 2 THEN 'Infinity'::DOUBLE ELSE price END AS price,
         CASE WHEN d = 3 THEN '-Infinity'::DOUBLE ELSE discount END AS discount,
         CASE WHEN d = 4 THEN NULL ELSE tax END AS tax,
         CASE WHEN d = 5 THEN NULL ELSE "Label" END AS "Label"
  FROM marked)"""

SPLIT_SQL = FLOWS_SQL + f""",
split AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY md5('split:' || flow_key))
            <= ceil(count(*) OVER (PARTITION BY client) * {SHARE}::DOUBLE) AS is_test
  FROM flows)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flow stream rows: client, source, malicious flag."""
    return as_stream_rows(table(spark, sf_dir, "events"))


def as_stream_rows(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3 + 1).cast("int").alias("client"),
        F.col("user_id").alias("source"), (F.col("event_type") == "error").alias("malicious"), "value",
    )


EVENTS_SQL = """flow_events AS (
  SELECT event_id, ts, CAST(user_id % 3 + 1 AS INT) AS client, user_id AS source,
         event_type = 'error' AS malicious, value
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with a 0/1 label made from the vector: sign of its first component."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 3 + 1).cast("int").alias("client"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("bigint").alias("label"),
        (F.col("embedding")[0] > 0).cast("bigint").alias("attack"),
    )


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS row_id, CAST(vec_id % 3 + 1 AS INT) AS client, CAST(embedding AS DOUBLE[]) AS features,
         CAST(label AS BIGINT) AS label, CAST(embedding[1] > 0 AS BIGINT) AS attack
  FROM embeddings)"""
