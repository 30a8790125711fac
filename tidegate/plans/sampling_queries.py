"""Splits, batches, mixture samples and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as s, scaling
from ..session import written
from .registry import register
from .views import FEATURES, FLOWS_SQL, KEY, SHARE, SPLIT_SQL, draw_sql, flows


@register("o17_train_test_split", "WITH " + SPLIT_SQL + """
SELECT client, is_test, count(*) AS n, round(sum(price), 2) AS price, min(flow_key) AS first_key
FROM split GROUP BY ALL""")
def train_test_split(spark, sf_dir):
    marked = s.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    return marked.groupBy("client", "is_test").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"), F.min("flow_key").alias("first_key")
    )


@register("o17_split_rows", "WITH " + SPLIT_SQL.replace(f"{SHARE}::DOUBLE", "0.1::DOUBLE") + """
SELECT client, flow_key FROM split WHERE is_test""")
def split_rows(spark, sf_dir):
    return s.train_test(flows(spark, sf_dir), 0.1, KEY)[1].select("client", "flow_key")


_ORDERED = "WITH " + FLOWS_SQL + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY md5('shuffle:{epoch}:' || flow_key)) - 1 AS row_idx
            FROM flows)"""


@register("o18_shuffle_rows", _ORDERED.format(epoch=1) + """
SELECT client, flow_key, CAST(row_idx AS BIGINT) AS row_idx FROM ordered""")
def shuffle_rows(spark, sf_dir):
    f = flows(spark, sf_dir).select("client", "flow_key")
    return s.shuffle_rows(f, KEY, epoch=1).select("client", "flow_key", "row_idx")


@register("o19_mini_batches", _ORDERED.format(epoch=0) + """
SELECT client, CAST(row_idx // 32 AS BIGINT) AS batch_id, count(*) AS n, round(sum(price), 2) AS price
FROM ordered GROUP BY ALL""")
def mini_batches(spark, sf_dir):
    f = flows(spark, sf_dir).select("client", "flow_key", "price")
    batches = s.mini_batches(s.shuffle_rows(f, KEY))
    return batches.groupBy("client", "batch_id").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price")
    )


_HOLDOUT = "WITH " + SPLIT_SQL + """,
holdout AS (SELECT * FROM split WHERE is_test)"""


MIXED_SQL = _HOLDOUT + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY md5('mix:' || flow_key)) - 1 AS row_idx FROM holdout),
sizes AS (SELECT client, count(*) AS n, row_number() OVER (ORDER BY client) - 1 AS pos FROM holdout GROUP BY client),
slots AS (SELECT i AS slot, {draw_sql("'mix-group:' || i")} % (SELECT count(*) FROM sizes) AS pos,
                 {draw_sql("'mix-row:' || i")} AS draw
          FROM range((SELECT count(*) // 3 FROM holdout)) t(i)),
mixed AS (SELECT s.slot, r.* FROM slots s JOIN sizes z USING (pos)
          JOIN ranked r ON r.client = z.client AND r.row_idx = s.draw % z.n)"""


def mixture(holdout):
    """As many rows as the mean hold-out has, a client uniformly and then one of its rows."""
    return s.mixture_sample(holdout, s.mean_holdout_size(holdout).first()[0], KEY)


@register("o20_mixture_sample", MIXED_SQL + """
SELECT slot, client, flow_key, price, attack FROM mixed""")
def mixture_sample(spark, sf_dir):
    mixed = mixture(written(s.train_test(flows(spark, sf_dir), SHARE, KEY)[1], "holdout"))
    return mixed.select("slot", "client", "flow_key", "price", "attack")


@register("o21_mean_holdout_size", _HOLDOUT + """
SELECT CAST(floor(count(*) / count(DISTINCT client)) AS BIGINT) AS mean_size FROM holdout""")
def mean_holdout_size(spark, sf_dir):
    return s.mean_holdout_size(s.train_test(flows(spark, sf_dir), SHARE, KEY)[1])


def _scaled(stats: str, centre: str, spread: str) -> str:
    columns = ", ".join(f"{centre.format(c=c)} AS m_{c}, {spread.format(c=c)} AS s_{c}" for c in FEATURES)
    z = ", ".join(
        f"round(avg((t.{c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} < 1e-14 THEN 1 ELSE s_{c} END), 6) AS mean_{c}, "
        f"round(stddev_pop((t.{c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} < 1e-14 THEN 1 ELSE s_{c} END), 6) AS sd_{c}"
        for c in FEATURES
    )
    return f"""WITH {SPLIT_SQL},
stats AS (SELECT {stats}{columns} FROM split WHERE NOT is_test GROUP BY ALL)
SELECT t.client, t.is_test, count(*) AS n, {z}
FROM split t JOIN stats s ON {'s.client = t.client' if stats else 'TRUE'}
GROUP BY ALL"""


def _moments(df):
    return df.groupBy("client", "is_test").agg(F.count("*").alias("n"), *[
        x for c in FEATURES
        for x in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.stddev_pop(c), 6).alias(f"sd_{c}"))
    ])


def _fitted(spark, sf_dir, fit, groups):
    marked = written(s.split_by_share(flows(spark, sf_dir), SHARE, KEY), "split")      # fits pass over it again
    stats = fit(marked.where(~F.col("is_test")), FEATURES, groups)
    return _moments(scaling.scale(marked, stats, FEATURES, groups))


@register("o22_standard_scaler", _scaled("", "avg({c})", "stddev_pop({c})"))
def standard_scaler(spark, sf_dir):
    return _fitted(spark, sf_dir, scaling.fit_standard, [])


_IQR = ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")


@register("o23_robust_scaler", _scaled("client, ", *_IQR))
def robust_scaler(spark, sf_dir):
    return _fitted(spark, sf_dir, scaling.fit_robust, ["client"])


@register("o23_robust_scaler_narrowed", _scaled("client, ", *_IQR))
def robust_scaler_narrowed(spark, sf_dir):
    """The path large groups take, forced: bracket, count, order only the bracket."""
    def narrowed(train, columns, groups):
        return scaling.fit_robust(train, columns, groups, direct_rows=0)

    return _fitted(spark, sf_dir, narrowed, ["client"])


@register("o24_per_client_scaler", _scaled("client, ", "avg({c})", "stddev_pop({c})"))
def per_client_scaler(spark, sf_dir):
    return _fitted(spark, sf_dir, scaling.fit_standard, ["client"])


@register("o24_scaled_mixture", MIXED_SQL + """,
stats AS (SELECT client, avg(price) AS m, stddev_pop(price) AS s FROM split WHERE NOT is_test GROUP BY client)
SELECT client, count(*) AS n, round(avg((price - m) / s), 6) AS mean_price, round(avg(price), 3) AS raw_price
FROM mixed JOIN stats USING (client) GROUP BY client""")
def scaled_mixture(spark, sf_dir):
    """The mixed test set, scaled with its source client's statistics; the raw form beside it."""
    train, test = s.train_test(flows(spark, sf_dir), SHARE, KEY)
    raw = mixture(test).select("client", "price", F.col("price").alias("raw_price"))
    mixed = scaling.scale(raw, scaling.fit_standard(train, ["price"]), ["price"])
    return mixed.groupBy("client").agg(
        F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price"),
        F.round(F.avg("raw_price"), 3).alias("raw_price"),
    )
