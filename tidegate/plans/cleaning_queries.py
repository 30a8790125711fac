"""Cleaning, encoding and assembling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as c
from .registry import register
from .views import DIRTY_SQL, FEATURES, FLOWS_SQL, dirty_flows, flows, table


def _sums(*names):
    return [F.round(F.sum(n), 2).alias(n) for n in names]


@register("o08_drop_identifiers", """
SELECT CAST(l_suppkey % 3 + 1 AS INT) AS client, l_linenumber AS packets, l_quantity AS quantity,
       count(*) AS n
FROM lineitem GROUP BY ALL""")
def drop_identifiers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    raw = l.select(
        F.col("l_orderkey").alias("sAddress"), F.col("l_partkey").alias("rAddress"), F.col("l_shipdate").alias("startDate"),
        F.col("l_linestatus").alias("protocol"), F.col("l_returnflag").alias("IT_B_Label"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("client"), F.col("l_linenumber").alias("packets"),
        F.col("l_quantity").alias("quantity"),
    )
    kept = c.drop_identifiers(raw)
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


@register("o09_fill_gaps", "WITH " + DIRTY_SQL + """
SELECT client, count(*) AS n,
       round(sum(CASE WHEN quantity IS NULL THEN 0 ELSE quantity END), 2) AS quantity,
       round(sum(CASE WHEN tax IS NULL THEN 0 ELSE tax END), 2) AS tax,
       count(*) FILTER (WHERE coalesce("Label", '0') = '0') AS unlabelled,
       count(*) FILTER (WHERE isnan(price)) * 0 AS price_gaps
FROM dirty GROUP BY client""")
def fill_gaps(spark, sf_dir):
    filled = c.fill_gaps(dirty_flows(spark, sf_dir), strings=True)
    return filled.groupBy("client").agg(
        F.count("*").alias("n"), *_sums("quantity", "tax"),
        F.count_if(F.col("Label") == "0").alias("unlabelled"),
        F.count_if(F.isnan("price") | F.col("price").isNull()).alias("price_gaps"),
    )


@register("o10_trim_headers", "WITH " + FLOWS_SQL + """
SELECT client, round(sum(quantity), 2) AS f01, round(sum(price), 2) AS f02, round(sum(tax), 2) AS "f02.1"
FROM flows GROUP BY client""")
def trim_headers(spark, sf_dir):
    f = flows(spark, sf_dir).select("client", "quantity", "price", "tax")
    trimmed = c.trim_headers(f.toDF("client ", " f01", "f02 ", " f02"))
    return trimmed.groupBy("client").agg(
        *[F.round(F.sum(F.col(f"`{n}`")), 2).alias(n) for n in ("f01", "f02", "f02.1")]
    )


_FINITE = "CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0 ELSE {c} END"


def finite_sql(column: str) -> str:
    return _FINITE.format(c=column)


@register("o11_repair_infinities", "WITH " + DIRTY_SQL + "\nSELECT client, count(*) AS n, " + ", ".join(
    f"round(sum({finite_sql(f)}), 2) AS {f}" for f in FEATURES) + "\nFROM dirty GROUP BY client")
def repair_infinities(spark, sf_dir):
    repaired = c.repair_infinities(dirty_flows(spark, sf_dir), FEATURES)
    return repaired.groupBy("client").agg(F.count("*").alias("n"), *_sums(*FEATURES))


@register("o12_binarise_label", "WITH " + DIRTY_SQL + """
SELECT client, CASE WHEN "Label" = 'BENIGN' THEN 'BENIGN' ELSE 'MALIGNANT' END AS "Label", count(*) AS n
FROM dirty GROUP BY ALL""")
def binarise_label(spark, sf_dir):
    return c.binarise_label(dirty_flows(spark, sf_dir)).groupBy("client", "Label").agg(F.count("*").alias("n"))


@register("o13_encode_label", "WITH " + FLOWS_SQL + """,
codes AS (SELECT "Label", row_number() OVER (ORDER BY "Label") - 1 AS label_code
          FROM (SELECT DISTINCT "Label" FROM flows WHERE client <> 3))
SELECT f.client, f."Label", CAST(c.label_code AS BIGINT) AS label_code, count(*) AS n
FROM flows f LEFT JOIN codes c USING ("Label") GROUP BY ALL""")
def encode_label(spark, sf_dir):
    f = flows(spark, sf_dir)
    codes = c.fit_label_codes(f.where(F.col("client") != 3))
    return c.encode_label(f, codes).groupBy("client", "Label", "label_code").agg(F.count("*").alias("n"))


@register("o14_assemble_features", "WITH " + FLOWS_SQL + """
SELECT attack, count(*) AS n, CAST(4 AS INT) AS width, round(sum(quantity), 2) AS first, round(sum(tax), 2) AS last
FROM flows GROUP BY attack""")
def assemble_features(spark, sf_dir):
    x = c.assemble_features(flows(spark, sf_dir), FEATURES)
    return x.groupBy("attack").agg(
        F.count("*").alias("n"), F.max(F.size("features")).alias("width"),
        F.round(F.sum(F.col("features")[0]), 2).alias("first"), F.round(F.sum(F.col("features")[3]), 2).alias("last"),
    )


@register("o15_cast_types", "WITH " + FLOWS_SQL + """
SELECT client, label, count(*) AS n, round(sum(CAST(CAST(price AS FLOAT) AS DOUBLE)), 2) AS price
FROM (SELECT client, price, TRY_CAST("Label" AS BIGINT) AS label FROM flows
      UNION ALL SELECT client, price, attack AS label FROM flows) GROUP BY ALL""")
def cast_types(spark, sf_dir):
    f = flows(spark, sf_dir)
    text = f.select("client", F.col("price").cast("string").alias("price"), F.col("Label").alias("label"))
    number = f.select("client", F.col("price").cast("string").alias("price"), F.col("attack").cast("string").alias("label"))
    typed = c.cast_types(text.unionByName(number), ["price"], "label")
    return typed.groupBy("client", "label").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("price").cast("double")), 2).alias("price")
    )


@register("o16_check_width", "WITH " + DIRTY_SQL + """
SELECT client, count(*) AS n_rows,
       count(*) FILTER (WHERE quantity IS NULL OR tax IS NULL OR isnan(price)) AS n_bad
FROM dirty GROUP BY client""")
def check_width(spark, sf_dir):
    d = dirty_flows(spark, sf_dir)
    c.require_width(d, FEATURES, 4)
    return c.width_violations(c.assemble_features(d, FEATURES), 4, groups=["client"])


@register("o39_append_tables", "WITH " + FLOWS_SQL + """
SELECT client, count(*) AS n, round(sum(price), 2) AS price FROM flows GROUP BY client""")
def append_tables(spark, sf_dir):
    f = flows(spark, sf_dir)
    parts = [f.where(F.col("client") == i).select("client", "price") for i in (1, 2, 3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("client").agg(F.count("*").alias("n"), *_sums("price"))


@register("o40_label_beside_features", "WITH " + FLOWS_SQL + """
SELECT flow_key, quantity, price, discount, tax, attack FROM flows""")
def label_beside_features(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_key", *FEATURES, "attack")
