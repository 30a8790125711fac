"""Training, scoring, federation and classifiers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.columns import digest, draw_int
from ..operators import classifiers, comparison, federation, metrics, sampling, scaling, training
from ..operators.cleaning import assemble_features
from ..operators.neighbours import nearest_neighbours, vote
from ..operators.networks import VARIANTS, Layout, initial_parameters, parameter_table, score
from ..session import stable, written
from .network_sql import network_sql
from .registry import register
from .views import FEATURES, FLOWS_SQL, KEY, SHARE, SPLIT_SQL, VECTORS_SQL, draw_sql, flows, vectors

# Layouts for the four-feature flow view.
SMALL = Layout("small", (4, 8, 2))
WIDE = Layout("wide", (4, 16, 2), head="softmax", dropout=0.4, spare=(16,))


@register("o41_initial_parameters", "WITH " + FLOWS_SQL + f""",
chosen AS (SELECT client FROM (SELECT DISTINCT client FROM flows) ORDER BY md5('first:' || client) LIMIT 1),
draws AS (SELECT client, p, {draw_sql("'start-' || client || ':' || p")} / 1152921504606846976.0 AS u FROM chosen, range(58) t(p))
SELECT CAST(0 AS INT) AS round, client, CAST(p AS INT) AS pos,
       round((2 * u - 1) * CASE WHEN p < 40 THEN 1 / sqrt(4) ELSE 1 / sqrt(8) END, 9) AS w FROM draws""")
def start_parameters(spark, sf_dir):
    """One client, picked at random, draws the start parameters of the run."""
    clients = flows(spark, sf_dir).select("client").distinct()
    client = clients.orderBy(digest("first", "client")).first()[0]
    params = parameter_table(spark, initial_parameters(SMALL, f"start-{client}"), 0, client)
    return params.select("round", "client", F.posexplode("w").alias("pos", "w")).withColumn("w", F.round("w", 9))


def _variant_sql(layout: Layout) -> str:
    return "WITH " + VECTORS_SQL + ",\n" + network_sql(
        layout, layout.name, "(SELECT row_id, features AS x FROM vectors)", "row_id", "scored"
    ) + """
SELECT row_id, CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT) AS pred, round(list_max(scores), 6) AS top,
       CAST(len(scores) AS INT) AS n_scores FROM scored"""


def _score_variant(layout, spark, sf_dir):
    scored = score(vectors(spark, sf_dir), layout, initial_parameters(layout, layout.name))
    return scored.select(
        "row_id", "pred", F.round(F.array_max("scores"), 6).alias("top"), F.size("scores").alias("n_scores")
    )


for _name, _layout in VARIANTS.items():
    _fitted = _layout.with_input(64)
    register(f"o42_score_{_name}", _variant_sql(_fitted))(partial(_score_variant, _fitted))


def prepared(spark, sf_dir):
    """Flows split per client and standard-scaled with each client's train rows, features packed."""
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    stats = scaling.fit_standard(marked.where(~F.col("is_test")), FEATURES)
    return assemble_features(scaling.scale(marked, stats, FEATURES), FEATURES)


_Z = ", ".join(f"(t.{c} - m_{c}) / CASE WHEN s_{c} < 1e-14 THEN 1 ELSE s_{c} END" for c in FEATURES)

PREPARED_SQL = SPLIT_SQL + f""",
stats AS (SELECT client, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)}
          FROM split WHERE NOT is_test GROUP BY client),
prepared AS (SELECT client, flow_key, attack, is_test, [{_Z}] AS x FROM split t JOIN stats USING (client))"""


@register("o42_score_flows", "WITH " + PREPARED_SQL + ",\n" + network_sql(
    SMALL, "round-0", "prepared", "flow_key", "scored") + """
SELECT client, count(*) AS n, round(avg(CAST(attack = (CASE WHEN scores[2] > scores[1] THEN 1 ELSE 0 END) AS DOUBLE)), 6) AS accuracy,
       round(avg(list_max(scores)), 6) AS top
FROM scored JOIN prepared USING (flow_key) GROUP BY client""")
def score_flows(spark, sf_dir):
    """All flows through a small network that stays one generated expression."""
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    stats = scaling.fit_standard(marked.where(~F.col("is_test")), FEATURES)
    scaled = scaling.scale(marked, stats, FEATURES)
    scored = score(scaled, SMALL, initial_parameters(SMALL, "round-0"), FEATURES)
    return scored.groupBy("client").agg(
        F.count("*").alias("n"), F.round(F.avg(metrics.is_hit("attack", "pred")), 6).alias("accuracy"),
        F.round(F.avg(F.array_max("scores")), 6).alias("top"),
    )


def shards_and_holdout(spark, sf_dir, rows_per_shard=training.ROWS_PER_SHARD):
    """Prepared once and stored: every later pass reads a few columns instead of splitting again."""
    rows = written(prepared(spark, sf_dir).select("client", "flow_key", "is_test", "features", "attack"), "prepared")
    shards = training.lay_out_shards(
        rows.where(~F.col("is_test")), KEY, "attack", rows_per_shard=rows_per_shard
    )
    holdout = sampling.mini_batches(sampling.shuffle_rows(rows.where("is_test"), KEY))
    return shards, holdout


@register("o43_local_training")
def local_training(spark, sf_dir):
    """Ten epochs per client with each optimiser; loss and accuracy per epoch."""
    shards, _ = shards_and_holdout(spark, sf_dir)
    start = initial_parameters(SMALL, "start")
    jobs = {
        i: (training.Fit(name, lr=0.01, epochs=10), start) for i, name in enumerate(("Adam", "RMSprop", "SGD"))
    }
    history = metrics.epoch_history(
        training.fit_history(training.fit_shards(shards, SMALL, jobs)), ["job", "client", "epoch"]
    )
    return history.select(
        "job", "client", "epoch", "n", F.round("loss_per_row", 6).alias("loss_per_row"),
        F.round("loss_per_batch", 5).alias("loss_per_batch"), F.round("accuracy", 5).alias("accuracy"),
    ).orderBy("job", "client", "epoch")


_WEIGHTS = [0.1, 0.2, -0.1, 0.05]
_BIAS, _RATE = -0.1, 0.5
_SIGMA = "1 / (1 + exp(-({} + {})))".format(_BIAS, " + ".join(f"{w} * x[{i + 1}]" for i, w in enumerate(_WEIGHTS)))


@register("o43_logistic_gradient_round", "WITH " + PREPARED_SQL + f""",
errors AS (SELECT client, x, {_SIGMA} - attack AS e FROM prepared WHERE NOT is_test),
local AS (SELECT client, count(*) AS n, """ + ", ".join(
    f"{w} - {_RATE} * avg(e * x[{i + 1}]) AS w{i}" for i, w in enumerate(_WEIGHTS)
) + f""", {_BIAS} - {_RATE} * avg(e) AS w4 FROM errors GROUP BY client)
SELECT CAST(sum(n) AS BIGINT) AS n, """ + ", ".join(f"round(sum(n * w{i}) / sum(n), 6) AS w{i}" for i in range(5)) + """
FROM local""")
def logistic_gradient_round(spark, sf_dir):
    """One gradient step per client as an aggregation, then the average over clients."""
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    train = marked.where(~F.col("is_test"))
    scaled = scaling.scale(train, scaling.fit_standard(train, FEATURES), FEATURES)
    local = federation.logistic_gradient_step(scaled, FEATURES, "attack", _WEIGHTS, _BIAS, _RATE)
    merged = federation.average_parameters(local, [])
    return merged.select("n", *[F.round(F.col("w")[i], 6).alias(f"w{i}") for i in range(5)])


@register("o44_federated_run")
def federated_run(spark, sf_dir, epochs=10, rounds=3):
    """Three rounds of ten local epochs, SGD with momentum, batches of 32; every round evaluated."""
    shards, holdout = shards_and_holdout(spark, sf_dir)
    run = federation.federate(shards, WIDE, training.Fit("SGD", epochs=epochs), rounds=rounds)
    records = federation.evaluate_rounds(holdout, WIDE, run.models, label="attack")
    return federation.federated_metrics(records).select(
        "round", F.round("accuracy", 4).alias("accuracy"), F.round("loss", 3).alias("loss")
    ).orderBy("round")


def _evaluation_sql() -> str:
    parts = ["WITH " + PREPARED_SQL + """,
holdout AS (SELECT *, (row_number() OVER (PARTITION BY client ORDER BY md5('shuffle:0:' || flow_key)) - 1) // 32 AS batch_id
            FROM prepared WHERE is_test)"""]
    for r in range(3):
        parts.append(network_sql(SMALL, f"round-{r}", "holdout", "flow_key", f"scored{r}", tag=f"_{r}_"))
    parts.append("scored AS (" + " UNION ALL ".join(
        f"SELECT CAST({r} AS INT) AS round, * FROM scored{r}" for r in range(3)) + ")")
    return ",\n".join(parts) + """,
losses AS (SELECT round, client, batch_id, ln(exp(scores[1]) + exp(scores[2])) - scores[attack + 1] AS ce,
                  CAST(attack = (CASE WHEN scores[2] > scores[1] THEN 1 ELSE 0 END) AS INT) AS hit
           FROM scored JOIN holdout USING (flow_key)),
clients AS (SELECT round, client, sum(mean) AS loss, sum(n) AS n, round(100 * sum(hits) / sum(n), 2) AS accuracy
            FROM (SELECT round, client, batch_id, avg(ce) AS mean, count(*) AS n, sum(hit) AS hits FROM losses GROUP BY ALL)
            GROUP BY ALL)
SELECT round, round(sum(n * accuracy) / sum(n), 4) AS accuracy, round(sum(n * loss) / sum(n), 4) AS loss FROM clients GROUP BY round"""


@register("o45_federated_evaluation", _evaluation_sql())
def federated_evaluation(spark, sf_dir):
    """Every client scores its hold-out with the models of three rounds."""
    rows = prepared(spark, sf_dir)
    holdout = sampling.mini_batches(sampling.shuffle_rows(rows.where("is_test"), KEY))
    models = {r: initial_parameters(SMALL, f"round-{r}") for r in range(3)}
    records = federation.evaluate_rounds(holdout, SMALL, models, label="attack")
    return federation.federated_metrics(records).select(
        "round", F.round("accuracy", 4).alias("accuracy"), F.round("loss", 4).alias("loss")
    )


_KNN_SQL = "WITH " + VECTORS_SQL + """,
marked AS (SELECT *, row_number() OVER (ORDER BY md5('split:' || row_id)) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM vectors),
pairs AS (SELECT q.row_id, q.label AS truth, t.label AS voted, list_distance(q.features, t.features) AS d,
                 row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.features, t.features), t.row_id) AS place
          FROM marked q JOIN marked t ON q.is_test AND NOT t.is_test),
votes AS (SELECT row_id, truth, voted, count(*) AS n, max(d) AS far FROM pairs WHERE place <= 5 GROUP BY ALL)
SELECT row_id, truth AS label, arg_max(voted, n * 1000 - voted) AS pred, round(max(far), 5) AS reach
FROM votes GROUP BY ALL"""


@register("o46_nearest_neighbours", _KNN_SQL)
def nearest(spark, sf_dir):
    """Five nearest train vectors of every test vector: predicted label and distance of the fifth."""
    train, test = sampling.train_test(vectors(spark, sf_dir), SHARE, ["row_id"], groups=[])
    found = stable(nearest_neighbours(train, test, 5, train_id="row_id", test_id="row_id"))
    reach = found.groupBy("test_id").agg(F.round(F.max("dist"), 5).alias("reach"))
    both = vote(found).join(reach, "test_id").withColumnRenamed("test_id", "row_id")
    return test.join(both, "row_id").select("row_id", "label", "pred", "reach")


def numbered(rows):
    """Prepared flows with a BIGINT row id from the key hash and a 0/1 ``label``."""
    return rows.select(
        draw_int(digest("row", "flow_key")).alias("row_id"), "client", "is_test", "features",
        F.col("attack").alias("label"),
    )


def _train_test_rows(spark, sf_dir):
    """Stored once: learners pass over their rows many times."""
    rows = written(numbered(prepared(spark, sf_dir)), "rows")
    return rows.where(~F.col("is_test")), rows.where("is_test")


def _client_accuracy(predicted):
    out = metrics.accuracy(predicted, "label", "pred", ["client"])
    return out.withColumn("accuracy", F.round("accuracy", 4)).orderBy("client")


@register("o46_knn_flows")
def knn_flows(spark, sf_dir):
    """All hold-out flows against all train flows."""
    return _client_accuracy(classifiers.knn(*_train_test_rows(spark, sf_dir)))


@register("o47_decision_tree")
def tree(spark, sf_dir):
    return _client_accuracy(classifiers.decision_tree(*_train_test_rows(spark, sf_dir)))


@register("o48_random_forest")
def forest(spark, sf_dir):
    return _client_accuracy(classifiers.random_forest(*_train_test_rows(spark, sf_dir)))


@register("o49_support_vectors")
def svm(spark, sf_dir):
    return _client_accuracy(classifiers.support_vectors(*_train_test_rows(spark, sf_dir)))


@register("o50_central_perceptron")
def central_perceptron(spark, sf_dir):
    return _client_accuracy(classifiers.perceptron(*_train_test_rows(spark, sf_dir)))


@register("o51_model_comparison")
def model_comparison(spark, sf_dir):
    """All five algorithms at their defaults, three clients as data sets, ten repeats; mean and spread of the accuracy."""
    rows = written(numbered(prepared(spark, sf_dir)).withColumnRenamed("client", "dataset"), "rows")
    accuracies = comparison.compare(rows, ["row_id"], SHARE, repeats=10)
    return classifiers.comparison_summary(accuracies).select(
        "dataset", "algorithm", "repeats", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "min", "max")]
    ).orderBy("dataset", "algorithm")
