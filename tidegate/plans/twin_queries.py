"""Learners in settings that SQL can follow exactly.

With one batch larger than any shard a local epoch is one full-batch gradient
step; its row-weighted mean over shards and clients does not depend on how rows
are placed, so rounds and trials become chains of aggregations.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.columns import digest
from ..operators import classifiers, federation, metrics, sampling, study, synchronous, training
from ..operators.networks import Layout, initial_parameters
from ..session import written
from .model_queries import PREPARED_SQL, prepared, shards_and_holdout
from .registry import register
from .views import FLOWS_SQL, KEY, SHARE, flows

LINEAR = Layout("linear", (4, 2))
ONE_BATCH = 1 << 40
NAMES = [*(f"a{j}" for j in range(4)), *(f"b{j}" for j in range(4)), "a4", "b4"]     # weights by class, then biases


def _score(c: str, s: str = "s") -> str:
    return " + ".join([*(f"{s}.{c}{j} * x[{j + 1}]" for j in range(4)), f"{s}.{c}4"])


def _start(number: int, seed: str, extra: str = "") -> str:
    values = initial_parameters(LINEAR, seed)
    return f"SELECT {number} AS number{extra}, " + ", ".join(f"{v!r}::DOUBLE AS {n}" for v, n in zip(values, NAMES))


def _steps_sql(rate: str, rounds: int) -> str:
    """CTEs s1 .. s<rounds>: full-batch steps of softmax regression over the train rows, from s0."""
    out = []
    for r in range(rounds):
        moves = [f"avg(e * x[{j + 1}])" for j in range(4)] + ["avg(e)"]
        new = [f"any_value(a{j}) + {rate} * {m} AS a{j}" for j, m in enumerate(moves)]
        new += [f"any_value(b{j}) - {rate} * {m} AS b{j}" for j, m in enumerate(moves)]
        out.append(f"""s{r + 1} AS (SELECT number, any_value(rate) AS rate, {", ".join(new)}
  FROM (SELECT s.*, x, 1 / (1 + exp(({_score("a")}) - ({_score("b")}))) - attack AS e
        FROM s{r} s, prepared WHERE NOT is_test) GROUP BY number)""")
    return ",\n".join(out)


@register("o44_full_batch_rounds", "WITH " + PREPARED_SQL + f""",
s0 AS ({_start(0, "start", ", 0.5 AS rate")}),
{_steps_sql("any_value(rate)", 3)},
n AS (SELECT count(*) AS n FROM prepared WHERE NOT is_test)
""" + " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS round, CAST(n AS BIGINT) AS n, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in NAMES) + f" FROM s{r}, n" for r in range(1, 4)))
def full_batch_rounds(spark, sf_dir):
    """Three federated rounds through lay-out, local fits and averaging; shards of 5,000 rows."""
    shards, _ = shards_and_holdout(spark, sf_dir, rows_per_shard=5_000)
    fit = training.Fit("SGD", lr=0.5, epochs=1, batch_size=ONE_BATCH)
    run = federation.federate(shards, LINEAR, fit, rounds=3, start=initial_parameters(LINEAR, "start"))
    return run.params.where("round > 0").select(
        "round", "n", *[F.round(F.col("w")[i], 6).alias(c) for i, c in enumerate(NAMES)])


@register("o43_full_batch_fit", "WITH " + PREPARED_SQL + f""",
s0 AS ({_start(0, "start")}),
errors AS (SELECT client, x, attack, ({_score("a")}) AS za, ({_score("b")}) AS zb FROM s0 s, prepared WHERE NOT is_test),
steps AS (SELECT client, count(*) AS n, """ + ", ".join(
    f"any_value(s.{c}{j}) {sign} 0.5 * avg((1 / (1 + exp(za - zb)) - attack) * {'x[%d]' % (j + 1) if j < 4 else '1'}) AS {c}{j}"
    for c, sign in (("a", "+"), ("b", "-")) for j in range(5)) + """
  FROM errors, s0 s GROUP BY client),
losses AS (SELECT client, sum(greatest(za, zb) + ln(1 + exp(-abs(za - zb))) - CASE attack WHEN 1 THEN zb ELSE za END) AS loss
           FROM errors GROUP BY client)
SELECT CAST(client AS INT) AS client, CAST(n AS BIGINT) AS n, round(loss / n, 6) AS loss, """ + ", ".join(
    f"round({c}, 6) AS {c}" for c in NAMES) + " FROM steps JOIN losses USING (client)")
def full_batch_fit(spark, sf_dir):
    """One local epoch of every client in one batch: its parameters and mean loss."""
    shards, _ = shards_and_holdout(spark, sf_dir)
    fit = training.Fit("SGD", lr=0.5, epochs=1, batch_size=None)
    fits = written(training.fit_shards(shards, LINEAR, {0: (fit, initial_parameters(LINEAR, "start"))}))
    merged = federation.average_parameters(fits, ["client"])
    loss = fits.groupBy("client").agg(F.sum(F.col("loss")[0] * F.col("n")).alias("loss"))
    return merged.join(loss, "client").select(
        "client", "n", F.round(F.col("loss") / F.col("n"), 6).alias("loss"),
        *[F.round(F.col("w")[i], 6).alias(c) for i, c in enumerate(NAMES)])


RATES = [0.5, 0.1, 0.02]


@register("o53_full_batch_study", "WITH " + PREPARED_SQL + ",\ns0 AS (" + " UNION ALL ".join(
    _start(k, f"trial-{k}", f", {rate} AS rate") for k, rate in enumerate(RATES)) + f"""),
{_steps_sql("any_value(rate)", 3)}
""" + " UNION ALL ".join(f"""SELECT CAST(number AS INT) AS number, CAST({r - 1} AS INT) AS step,
       round(avg(CAST(attack = CASE WHEN {_score("b")} > {_score("a")} THEN 1 ELSE 0 END AS DOUBLE)), 5) AS value
FROM s{r} s, prepared WHERE is_test GROUP BY number""" for r in range(1, 4)))
def full_batch_study(spark, sf_dir):
    """A study of three learning rates over three epochs, without pruning: hold-out accuracy per step."""
    shards, holdout = shards_and_holdout(spark, sf_dir, rows_per_shard=5_000)
    trials = spark.createDataFrame(pa.table({
        "number": pa.array(range(len(RATES)), pa.int64()), "params_lr": RATES,
        "params_optimizer": ["SGD"] * len(RATES),
    }))
    _, steps = study.run_study(
        shards, holdout, LINEAR, trials, epochs=3, batch_size=ONE_BATCH, prune=False, label="attack")
    return steps.select("number", "step", F.round("value", 5).alias("value"))


QUEUE_RATES = [0.5, 0.02, 0.3, 0.001, 0.1, 0.0005, 0.4, 0.01]
QUEUE_STARTUP, QUEUE_EPOCHS = 2, 3


def _queue_sql() -> str:
    """The trials of a study one by one: each is held against those complete before it."""
    last = QUEUE_EPOCHS - 1
    parts = ["WITH " + PREPARED_SQL + ",\ns0 AS (" + " UNION ALL ".join(
        _start(k, f"trial-{k}", f", {rate} AS rate") for k, rate in enumerate(QUEUE_RATES)) + ")",
        _steps_sql("any_value(rate)", QUEUE_EPOCHS),
        "steps AS (" + " UNION ALL ".join(f"""SELECT number, {r} AS step,
            avg(CAST(attack = CASE WHEN {_score("b")} > {_score("a")} THEN 1 ELSE 0 END AS DOUBLE)) AS value
            FROM s{r + 1} s, prepared WHERE is_test GROUP BY number""" for r in range(QUEUE_EPOCHS)) + ")",
        "so_far AS (SELECT *, max(value) OVER (PARTITION BY number ORDER BY step) AS best FROM steps)",
        "c0 AS (SELECT 0 AS number WHERE FALSE)"]
    for k in range(len(QUEUE_RATES)):
        parts.append(f"""stop{k} AS (SELECT coalesce(min(a.step), {last}) AS step, count(*) > 0 AS pruned FROM so_far a
  WHERE a.number = {k} AND a.step < {last} AND (SELECT count(*) FROM c{k}) >= {QUEUE_STARTUP}
    AND a.best < (SELECT quantile_cont(b.value, 0.5) FROM steps b WHERE b.step = a.step AND b.number IN (SELECT number FROM c{k}))),
c{k + 1} AS (SELECT number FROM c{k} UNION ALL SELECT {k} FROM stop{k} WHERE NOT pruned)""")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(f"""SELECT CAST({k} AS INT) AS number,
       CASE WHEN pruned THEN 'PRUNED' ELSE 'COMPLETE' END AS state, CAST(t.step + 1 AS BIGINT) AS epochs, round(value, 5) AS value
FROM stop{k} t JOIN steps s ON s.number = {k} AND s.step = t.step""" for k in range(len(QUEUE_RATES)))


@register("o54_trials_one_by_one", _queue_sql())
def trials_one_by_one(spark, sf_dir):
    """A study with one place: trials are trained in turn and pruned while they run."""
    shards, holdout = shards_and_holdout(spark, sf_dir, rows_per_shard=5_000)
    trials = spark.createDataFrame(pa.table({
        "number": pa.array(range(len(QUEUE_RATES)), pa.int64()), "params_lr": QUEUE_RATES,
        "params_optimizer": ["SGD"] * len(QUEUE_RATES),
    }))
    done, steps = study.run_study(
        shards, holdout, LINEAR, trials, epochs=QUEUE_EPOCHS, batch_size=ONE_BATCH, startup=QUEUE_STARTUP, slots=1,
        label="attack")
    counted = done.join(steps.groupBy("number").agg(F.count("*").alias("epochs")), "number")
    return counted.select("number", "state", "epochs", F.round("value", 5).alias("value"))


def mean_rule(column, train, test):
    """Predicts 1 above the train rows' mean of one feature."""
    mean = train.agg(F.avg(F.col("features")[column])).first()[0]
    return test.withColumn("pred", (F.col("features")[column] > mean).cast("bigint"))


def _comparison_sql() -> str:
    parts = [f"""WITH {FLOWS_SQL},
rows AS (SELECT client, flow_key, attack, [quantity, price, discount, tax] AS x FROM flows)"""]
    for r in (1, 2):
        parts.append(f"""m{r} AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY md5('repeat-{r}:' || flow_key))
                <= ceil(count(*) OVER (PARTITION BY client) * {SHARE}::DOUBLE) AS is_test FROM rows),
c{r} AS (SELECT client, avg(x[1]) AS m0, avg(x[2]) AS m1 FROM m{r} WHERE NOT is_test GROUP BY client)""")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(f"""SELECT CAST(client AS INT) AS dataset, '{name}' AS algorithm,
       CAST({r} AS INT) AS repeat, round(100 * avg(CAST(attack = CAST(x[{k + 1}] > m{k} AS INT) AS DOUBLE)), 6) AS accuracy
FROM m{r} JOIN c{r} USING (client) WHERE is_test GROUP BY client""" for r in (1, 2) for k, name in ((0, "quantity"), (1, "price")))


@register("o51_rule_comparison", _comparison_sql())
def rule_comparison(spark, sf_dir):
    """The comparison's own splits, data sets and repeats, with two rules in place of learners."""
    rows = flows(spark, sf_dir).select(
        F.col("client").alias("dataset"), "flow_key", F.col("attack").alias("label"),
        F.array("quantity", "price", "discount", "tax").cast("array<double>").alias("features"))
    rules = {"quantity": partial(mean_rule, 0), "price": partial(mean_rule, 1)}
    out = classifiers.compare_models(written(rows, "rows"), KEY, SHARE, 2, rules)
    return out.withColumn("accuracy", F.round("accuracy", 6))


_STUMP = "WITH " + FLOWS_SQL + f""",
marked AS (SELECT client, flow_key, discount AS x0, tax AS x1, attack AS label,
                  row_number() OVER (PARTITION BY client ORDER BY md5('split:' || flow_key))
                  <= ceil(count(*) OVER (PARTITION BY client) * {SHARE}::DOUBLE) AS is_test FROM flows),
train AS (SELECT * FROM marked WHERE NOT is_test),
cells AS (SELECT 0 AS f, x0 AS v, label, count(*) AS n FROM train GROUP BY ALL
          UNION ALL SELECT 1, x1, label, count(*) FROM train GROUP BY ALL),
cuts AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM (SELECT DISTINCT f, v FROM cells)),
sides AS (SELECT c.f, c.cut, sum(CASE WHEN k.v <= c.v AND label = 1 THEN n ELSE 0 END) AS l1,
                 sum(CASE WHEN k.v <= c.v THEN n ELSE 0 END) AS l,
                 sum(CASE WHEN k.v > c.v AND label = 1 THEN n ELSE 0 END) AS r1,
                 sum(CASE WHEN k.v > c.v THEN n ELSE 0 END) AS r
          FROM cuts c JOIN cells k USING (f) WHERE c.cut IS NOT NULL GROUP BY c.f, c.cut),
best AS (SELECT * FROM sides ORDER BY l1 * (l - l1) / l + r1 * (r - r1) / r, f, cut LIMIT 1)
SELECT client, count(*) AS n, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy, CAST(sum(pred) AS BIGINT) AS claimed
FROM (SELECT client, label, CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END <= cut THEN CAST(2 * l1 > l AS INT)
                                 ELSE CAST(2 * r1 > r AS INT) END AS pred
      FROM marked, best WHERE is_test) GROUP BY client"""


def _stump_rows(spark, sf_dir):
    """Two features of few distinct values, so that a learner's candidate cuts are all cuts."""
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    rows = written(marked.select("client", "is_test", F.array("discount", "tax").alias("features"), F.col("attack").alias("label")))
    return rows.where(~F.col("is_test")), rows.where("is_test")


def _claims(predicted):
    return metrics.accuracy(predicted.withColumn("pred", F.col("pred").cast("bigint")), "label", "pred", ["client"]).join(
        predicted.groupBy("client").agg(F.sum(F.col("pred").cast("bigint")).alias("claimed")), "client"
    ).select("client", "n", F.round("accuracy", 6).alias("accuracy"), "claimed")


@register("o47_best_split", _STUMP)
def best_split(spark, sf_dir):
    """A tree of depth one: its split is the one that SQL finds among all cuts."""
    return _claims(classifiers.decision_tree(*_stump_rows(spark, sf_dir), max_depth=1))


@register("o48_forest_of_one", _STUMP)
def forest_of_one(spark, sf_dir):
    """A forest of one tree over all rows and features, which is that tree."""
    return _claims(classifiers.random_forest(*_stump_rows(spark, sf_dir), count=1, max_depth=1, bootstrap=False, features=None))


_FLOW_VALUES = ("quantity", "price", "discount", "tax")


def _tree_sql(depth: int) -> str:
    """A tree by trying every cut of every feature at every node, level by level, on the pooled train rows."""
    parts = ["WITH " + FLOWS_SQL + f""",
marked AS (SELECT client, flow_key, attack AS label, {", ".join(f"{c} AS x{k}" for k, c in enumerate(_FLOW_VALUES))},
                  row_number() OVER (PARTITION BY client ORDER BY md5('split:' || flow_key))
                  <= ceil(count(*) OVER (PARTITION BY client) * {SHARE}::DOUBLE) AS is_test FROM flows),
at0 AS (SELECT *, 1 AS node FROM marked)"""]
    pick = "CASE f " + " ".join(f"WHEN {k} THEN x{k}" for k in range(len(_FLOW_VALUES))) + " END"
    for d in range(depth):
        cells = " UNION ALL ".join(
            f"SELECT node, {k} AS f, x{k} AS v, count(*) AS n, sum(label) AS c FROM at{d} WHERE NOT is_test GROUP BY ALL"
            for k in range(len(_FLOW_VALUES)))
        parts.append(f"""run{d} AS (SELECT node, f, v, lead(v) OVER o AS high, CAST(sum(n) OVER o AS BIGINT) AS l, CAST(sum(c) OVER o AS BIGINT) AS l1,
          CAST(sum(n) OVER p AS BIGINT) AS t, CAST(sum(c) OVER p AS BIGINT) AS t1 FROM ({cells})
          WINDOW p AS (PARTITION BY node, f), o AS (PARTITION BY node, f ORDER BY v)),
best{d} AS (SELECT node, f, v / 2 + high / 2 AS cut FROM run{d} WHERE high IS NOT NULL AND t1 > 0 AND t1 < t
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY
            (l * l - ((l - l1) * (l - l1) + l1 * l1)) / l + ((t - l) * (t - l) - ((t - l - t1 + l1) * (t - l - t1 + l1) + (t1 - l1) * (t1 - l1))) / (t - l),
            f, v) = 1),
at{d + 1} AS (SELECT a.* EXCLUDE (node), CASE WHEN f IS NULL THEN node WHEN {pick} <= cut THEN 2 * node ELSE 2 * node + 1 END AS node
          FROM at{d} a LEFT JOIN best{d} b USING (node))""")
    parts.append(f"leaves AS (SELECT node, CAST(2 * sum(label) > count(*) AS INT) AS pred FROM at{depth} WHERE NOT is_test GROUP BY node)")
    return ",\n".join(parts) + f"""
SELECT client, count(*) AS n, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy, CAST(sum(pred) AS BIGINT) AS claimed
FROM at{depth} JOIN leaves USING (node) WHERE is_test GROUP BY client"""


def _raw_rows(spark, sf_dir):
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    rows = written(marked.select(
        "client", "is_test", F.array(*_FLOW_VALUES).cast("array<double>").alias("features"), F.col("attack").alias("label")))
    return rows.where(~F.col("is_test")), rows.where("is_test")


@register("o47_exact_cuts", _tree_sql(3))
def exact_cuts(spark, sf_dir):
    """A tree of depth three over all values of four features, finished inside a task."""
    return _claims(classifiers.decision_tree(*_raw_rows(spark, sf_dir), max_depth=3))


@register("o47_cuts_by_levels", _tree_sql(4))
def cuts_by_levels(spark, sf_dir):
    """A tree of depth four; nodes of more than 500 rows are split by one aggregation over all rows per level."""
    return _claims(classifiers.decision_tree(*_raw_rows(spark, sf_dir), max_depth=4, task_rows=500))


_APART = "WITH " + FLOWS_SQL + f""",
marked AS (SELECT client, flow_key, quantity + 5 * tax > 25 AS label, tax,
                  quantity + CASE WHEN quantity + 5 * tax > 25 THEN 7 ELSE -7 END AS moved,
                  row_number() OVER (PARTITION BY client ORDER BY md5('split:' || flow_key))
                  <= ceil(count(*) OVER (PARTITION BY client) * {SHARE}::DOUBLE) AS is_test FROM flows)
SELECT client, count(*) AS n, round(avg(CAST(label = (moved + 5 * tax > 25) AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) FILTER (WHERE moved + 5 * tax > 25) AS BIGINT) AS claimed FROM marked WHERE is_test GROUP BY client"""


def _apart_rows(spark, sf_dir):
    """All flows, moved away from a plane that tells their labels apart: every learner must find it."""
    label = F.col("quantity") + 5 * F.col("tax") > 25
    marked = sampling.split_by_share(flows(spark, sf_dir), SHARE, KEY)
    moved = F.col("quantity") + F.when(label, 7).otherwise(-7)
    stored = written(marked.select(
        "client", "flow_key", "is_test", label.cast("bigint").alias("label"),
        F.array(moved / 25 - 1, F.col("tax"), F.col("discount")).alias("features")))
    return stored.where(~F.col("is_test")), stored.where("is_test")


@register("o49_separable", _APART)
def separable_vectors(spark, sf_dir):
    return _claims(classifiers.support_vectors(*_apart_rows(spark, sf_dir)))


@register("o50_separable", _APART)
def separable_perceptron(spark, sf_dir):
    return _claims(classifiers.perceptron(
        *_apart_rows(spark, sf_dir), hidden=(8,), epochs=60, batch_size=1 << 40, key=("flow_key",), lr=0.05))


def _batches_sql(batches: int, rate: float) -> str:
    """Plain descent over ``batches`` equal batches in hash order, one epoch, from the start parameters."""
    parts = ["WITH " + PREPARED_SQL + f""",
placed AS (SELECT x, attack, (row_number() OVER (ORDER BY md5('central:' || flow_key)) - 1)
                  // CAST(ceil(count(*) OVER () / {batches}.0) AS BIGINT) AS batch FROM prepared WHERE NOT is_test),
s0 AS ({_start(0, "start")})"""]
    for b in range(batches):
        moves = [f"avg(e * x[{j + 1}])" for j in range(4)] + ["avg(e)"]
        new = [f"any_value(a{j}) + {rate} * {m} AS a{j}" for j, m in enumerate(moves)]
        new += [f"any_value(b{j}) - {rate} * {m} AS b{j}" for j, m in enumerate(moves)]
        parts.append(f"""s{b + 1} AS (SELECT number, {", ".join(new)} FROM (
  SELECT s.*, x, 1 / (1 + exp(({_score("a")}) - ({_score("b")}))) - attack AS e FROM s{b} s, placed WHERE batch = {b}) GROUP BY number)""")
    return ",\n".join(parts) + f"""
SELECT (SELECT count(*) FROM placed) AS n, {", ".join(f"round({c}, 6) AS {c}" for c in NAMES)} FROM s{batches}"""


@register("o50_central_epoch", _batches_sql(5, 0.5))
def central_epoch(spark, sf_dir):
    """One epoch of synchronous training in five batches: the parameters that SQL reaches batch by batch."""
    train = prepared(spark, sf_dir).where(~F.col("is_test"))
    size = -(-train.count() // 5)
    fit = training.Fit("SGD", lr=0.5, momentum=0.0, epochs=1, batch_size=size)
    out = synchronous.train_central(
        train, LINEAR, fit, initial_parameters(LINEAR, "start"), digest("central", "flow_key"), label="attack")
    return spark.createDataFrame([(out.n, *(round(float(v), 6) for v in out.w))], "n bigint, " + ", ".join(f"{c} double" for c in NAMES))
