"""Metrics, reports, sorting and averaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import argmax, binary_cross_entropy, cross_entropy, sigmoid
from ..operators import metrics as m, sampling
from ..operators.federation import average_parameters
from .registry import register
from .source_queries import REPEATS_SQL, client_means, rule_repeats
from .views import FEATURES, FLOWS_SQL, KEY, VECTORS_SQL, flows, table, vectors

# A fixed score in place of a model: positive above the price cut.
_MARGIN_SQL = "(price * (1 - discount) / 50000 - 1 + 0.1 * (quantity - 25) / 25)"


def _margin():
    return F.col("price") * (1 - F.col("discount")) / 50000 - 1 + F.lit(0.1) * (F.col("quantity") - 25) / 25


def scored_flows(spark, sf_dir, *extra):
    """Flows with ``scores`` = [-margin, margin] and ``pred``."""
    f = flows(spark, sf_dir).withColumn("margin", _margin())
    s = f.withColumn("scores", F.array(-F.col("margin"), F.col("margin"))).withColumn("pred", argmax("scores"))
    return s.select("client", "flow_key", "attack", "Label", "margin", "scores", "pred", *extra)


SCORED_SQL = FLOWS_SQL + f""",
scored AS (SELECT *, CAST(margin > 0 AS BIGINT) AS pred, ln(exp(-margin) + exp(margin)) - CASE attack WHEN 1 THEN margin ELSE -margin END AS ce
           FROM (SELECT *, {_MARGIN_SQL} AS margin FROM flows))"""

BATCHED_SQL = SCORED_SQL + """,
batched AS (SELECT *, CAST((row_number() OVER (PARTITION BY client ORDER BY md5('shuffle:0:' || flow_key)) - 1) // 32 AS BIGINT) AS batch_id
            FROM scored)"""


def batched_flows(spark, sf_dir):
    return sampling.mini_batches(sampling.shuffle_rows(scored_flows(spark, sf_dir), KEY))


@register("o25_label_counts", "WITH " + FLOWS_SQL + """
SELECT "Label", count(*) AS n FROM flows GROUP BY ALL""")
def label_counts(spark, sf_dir):
    return m.label_counts(flows(spark, sf_dir))


@register("o26_accuracy", "WITH " + SCORED_SQL + """
SELECT client, count(*) AS n, round(avg(CAST(attack = pred AS DOUBLE)), 6) AS accuracy FROM scored GROUP BY ROLLUP (client)""")
def accuracy(spark, sf_dir):
    return m.accuracy_with_total(scored_flows(spark, sf_dir), "attack", "pred").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@register("o27_classification_report", """WITH
cells AS (SELECT CAST(toxic AS BIGINT) AS label, CAST(1 - quality AS BIGINT) AS pred, count(*) AS n FROM labels GROUP BY ALL),
classes AS (SELECT DISTINCT label AS c FROM cells UNION SELECT DISTINCT pred FROM cells),
per_class AS (
  SELECT c, coalesce(sum(n) FILTER (WHERE label = c AND pred = c), 0) AS hit,
         coalesce(sum(n) FILTER (WHERE label = c), 0) AS support, coalesce(sum(n) FILTER (WHERE pred = c), 0) AS claimed
  FROM classes, cells GROUP BY c),
rates AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hit / claimed END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM per_class),
scores AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM rates)
SELECT CAST(c AS VARCHAR) AS line, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall,
       round(CAST(f AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support FROM scores
UNION ALL SELECT 'accuracy', round(CAST(sum(hit) / sum(support) AS DOUBLE), 6), round(CAST(sum(hit) / sum(support) AS DOUBLE), 6),
       round(CAST(sum(hit) / sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', round(CAST(avg(p) AS DOUBLE), 6), round(CAST(avg(r) AS DOUBLE), 6), round(CAST(avg(f) AS DOUBLE), 6),
       CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', round(CAST(sum(p * support) / sum(support) AS DOUBLE), 6),
       round(CAST(sum(r * support) / sum(support) AS DOUBLE), 6), round(CAST(sum(f * support) / sum(support) AS DOUBLE), 6),
       CAST(sum(support) AS BIGINT) FROM scores""")
def classification_report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        F.col("toxic").cast("bigint").alias("label"), (1 - F.col("quality")).cast("bigint").alias("pred")
    )
    report = m.classification_report(rows)
    return report.select("line", *[F.round(s, 6).alias(s) for s in ("precision", "recall", "f1")], "support")


@register("o28_evaluation_loss", "WITH " + BATCHED_SQL + """
SELECT client, CAST(sum(n) AS BIGINT) AS n, round(sum(mean), 5) AS loss
FROM (SELECT client, batch_id, count(*) AS n, avg(ce) AS mean FROM batched GROUP BY ALL) GROUP BY client""")
def evaluation_loss(spark, sf_dir):
    loss = m.evaluation_loss(batched_flows(spark, sf_dir), label="attack", groups=["client"])
    return loss.withColumn("loss", F.round("loss", 5))


@register("o28_row_mean_loss", "WITH " + SCORED_SQL + """
SELECT client, count(*) AS n, round(avg(ce), 6) AS loss FROM scored GROUP BY client""")
def row_mean_loss(spark, sf_dir):
    loss = m.evaluation_loss(scored_flows(spark, sf_dir), label="attack", groups=["client"], how="row_mean")
    return loss.withColumn("loss", F.round("loss", 6))


@register("o29_binary_cross_entropy", "WITH " + SCORED_SQL + """
SELECT client, count(*) AS n, round(avg(-(CASE attack WHEN 1 THEN ln(p) ELSE ln(1 - p) END)), 6) AS loss
FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM scored) GROUP BY client""")
def bce(spark, sf_dir):
    s = scored_flows(spark, sf_dir).withColumn("p", sigmoid("margin"))
    return m.bce_loss(s, "p", "attack", ["client"]).withColumn("loss", F.round("loss", 6))


@register("o30_epoch_history", "WITH " + SCORED_SQL + """,
shuffled AS (SELECT s.*, CAST(e AS INT) AS epoch,
                    (row_number() OVER (PARTITION BY client, e ORDER BY md5('shuffle:' || e || ':' || flow_key)) - 1) // 32 AS batch_id
             FROM scored s, range(1, 3) t(e)),
batches AS (SELECT client, epoch, batch_id, count(*) AS n, avg(ce) AS loss, sum(CAST(attack = pred AS INT)) AS correct
            FROM shuffled GROUP BY ALL)
SELECT client, epoch, CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(n), 7) AS loss_per_row,
       round(sum(loss) / count(*), 6) AS loss_per_batch, round(sum(correct) / sum(n), 6) AS accuracy
FROM batches GROUP BY ALL""")
def epoch_history(spark, sf_dir):
    """Batch records of two epochs, each with its own row order."""
    s = scored_flows(spark, sf_dir)
    records = None
    for epoch in (1, 2):
        batched = sampling.mini_batches(sampling.shuffle_rows(s, KEY, epoch=epoch))
        part = batched.groupBy("client", "batch_id").agg(
            F.count("*").alias("n"), F.avg(cross_entropy("scores", "attack")).alias("loss"),
            F.sum(m.is_hit("attack", "pred")).alias("correct"),
        ).select(
            "client", F.lit(epoch).alias("epoch"), "n", "loss", F.lit(1).alias("batches"), "correct"
        )
        records = part if records is None else records.unionByName(part)
    return m.epoch_history(records, ["client", "epoch"]).select(
        "client", "epoch", "n", F.round("loss_per_row", 7).alias("loss_per_row"),
        F.round("loss_per_batch", 6).alias("loss_per_batch"), F.round("accuracy", 6).alias("accuracy"),
    )


_ROUNDS_SQL = """,
rounds AS (SELECT *, CAST(margin + shift > 0 AS BIGINT) AS round_pred,
                  ln(exp(-(margin + shift)) + exp(margin + shift)) - CASE attack WHEN 1 THEN margin + shift ELSE -(margin + shift) END AS round_ce
           FROM (SELECT b.*, CAST(r AS INT) AS round, (3 - r) * 0.2 AS shift FROM batched b, range(0, 4) t(r)))"""


def _rounds(spark, sf_dir):
    """Four rounds of scores: the margin is shifted less every round."""
    b = batched_flows(spark, sf_dir)
    r = b.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    r = r.withColumn("margin", F.col("margin") + (3 - F.col("round")) * F.lit(0.2))
    return r.withColumn("scores", F.array(-F.col("margin"), F.col("margin"))).withColumn("pred", argmax("scores"))


@register("o31_weighted_mean", "WITH " + BATCHED_SQL + _ROUNDS_SQL + """
SELECT round, round(sum(n * accuracy) / sum(n), 6) AS accuracy
FROM (SELECT round, client, count(*) AS n, avg(CAST(attack = round_pred AS DOUBLE)) AS accuracy FROM rounds GROUP BY ALL)
GROUP BY round""")
def weighted_mean(spark, sf_dir):
    s = scored_flows(spark, sf_dir).withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    s = s.withColumn("pred", (F.col("margin") + (3 - F.col("round")) * F.lit(0.2) > 0).cast("bigint"))
    per_client = m.accuracy(s, "attack", "pred", ["round", "client"])
    return m.weighted_mean(per_client).withColumn("accuracy", F.round("accuracy", 6))


@register("o32_average_parameters", "WITH " + FLOWS_SQL + """,
cells AS (SELECT client, count(*) AS n, """ + ", ".join(f"avg({c}) AS {c}" for c in FEATURES) + """
          FROM flows GROUP BY client)
SELECT CAST(r AS INT) AS round, CAST(sum(n) AS BIGINT) AS n, """ + ", ".join(
    f"round(sum(n * r * {c}) / sum(n), 6) AS {c}" for c in FEATURES) + """
FROM cells, range(1, 4) t(r) GROUP BY r""")
def averaged_parameters(spark, sf_dir):
    merged = average_parameters(client_means(spark, sf_dir))
    return merged.select("round", "n", *[F.round(F.col("w")[i], 6).alias(c) for i, c in enumerate(FEATURES)])


@register("o32_average_long_parameters", """WITH """ + VECTORS_SQL + """,
cells AS (SELECT label AS round, row_id % 5 AS client, row_id + 1 AS n, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM vectors)
SELECT CAST(round AS INT) AS round, CAST(pos - 1 AS INT) AS pos, round(sum(n * v) / sum(n), 6) AS w FROM cells GROUP BY ALL""")
def averaged_long_parameters(spark, sf_dir):
    """64 positions, ten rounds: every vector stands for one client's parameters."""
    params = vectors(spark, sf_dir).select(
        F.col("label").cast("int").alias("round"), (F.col("row_id") + 1).alias("n"), F.col("features").alias("w")
    )
    merged = average_parameters(params)
    return merged.select("round", F.posexplode("w").alias("pos", "w")).withColumn("w", F.round("w", 6))


@register("o33_server_evaluation", "WITH " + BATCHED_SQL + _ROUNDS_SQL + """,
per_set AS (SELECT round, client, sum(mean) AS loss, 100 * sum(hits) / sum(n) AS pct
            FROM (SELECT round, client, batch_id, avg(round_ce) AS mean, count(*) AS n, sum(CAST(attack = round_pred AS INT)) AS hits
                  FROM rounds GROUP BY ALL) GROUP BY ALL)
SELECT round, round(avg(pct), 6) AS mean_accuracy_pct, round(max_by(loss, client), 4) AS loss,
       round(sum(loss), 4) AS all_losses, CAST(count(*) AS INT) AS n_sets FROM per_set GROUP BY round""")
def server_evaluation(spark, sf_dir):
    r = _rounds(spark, sf_dir).withColumn("loss", cross_entropy("scores", "attack"))
    out = m.server_evaluation(r, "attack", "pred", "loss", dataset="client")
    return out.select(
        "round", F.round("mean_accuracy_pct", 6).alias("mean_accuracy_pct"), F.round("loss", 4).alias("loss"),
        F.round(F.aggregate("losses", F.lit(0.0), lambda a, v: a + v), 4).alias("all_losses"),
        F.size("losses").alias("n_sets"),
    )


@register("o34_repeat_summary", "WITH " + REPEATS_SQL + """
SELECT dataset, algorithm, count(*) AS repeats, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd,
       round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max FROM repeats GROUP BY ALL""")
def repeat_summary(spark, sf_dir):
    out = m.repeat_summary(rule_repeats(spark, sf_dir))
    return out.select("dataset", "algorithm", "repeats", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")])


@register("o35_client_record", "WITH " + BATCHED_SQL + _ROUNDS_SQL + """
SELECT client, round, round(sum(mean), 4) AS loss, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(hits) / sum(n), 2) AS accuracy
FROM (SELECT round, client, batch_id, avg(round_ce) AS mean, count(*) AS n, sum(CAST(attack = round_pred AS INT)) AS hits
      FROM rounds GROUP BY ALL) GROUP BY ALL""")
def client_record(spark, sf_dir):
    out = m.client_record(_rounds(spark, sf_dir), label="attack")
    return out.withColumn("loss", F.round("loss", 4))


@register("o38_argmax", "WITH " + VECTORS_SQL + """
SELECT row_id, CAST(list_position(features, list_max(features)) - 1 AS BIGINT) AS pred FROM vectors""")
def row_argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("row_id", argmax("features").alias("pred"))
