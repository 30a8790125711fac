"""Shape of the physical plans the operators rely on at scale."""

import re

import __spark_entry__ as contract
from pyspark.sql import functions as F

from tidegate.operators import metrics, sampling, scaling
from tidegate.operators.networks import Layout, initial_parameters, score
from tidegate.plans.views import FEATURES, KEY, SHARE, flows

from conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 4 and all(0.5 < r["accuracy"] <= 1 for r in rows)
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    covered = {int(m.group(1)) for q in queries if (m := re.match(r"o(\d\d)_", q))}
    assert covered == set(range(1, 64))


def test_scan_reads_only_used_columns(spark):
    plan = plan_of(metrics.label_counts(flows(spark, SF)))
    assert "ReadSchema: struct<l_returnflag:string>" in plan


def test_filter_reaches_the_scan(spark):
    plan = plan_of(flows(spark, SF).where(F.col("price") > 50000).groupBy("client").count())
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,50000.0)" in plan


def test_split_scale_score_moves_no_rows(spark):
    """The whole preparation is one scan with broadcast facts: no exchange of rows, no Python."""
    marked = sampling.split_by_share(flows(spark, SF), SHARE, KEY)
    stats = scaling.fit_standard(marked.where(~F.col("is_test")), FEATURES)
    layout = Layout("small", (4, 8, 2))
    scored = score(scaling.scale(marked, stats, FEATURES), layout, initial_parameters(layout), FEATURES)
    plan = plan_of(scored)
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert plan.count("BroadcastHashJoin") == 2


def test_no_row_at_a_time_python(spark):
    marked = flows(spark, SF).withColumn("features", F.array(*FEATURES))
    layout = Layout("wide", (4, 64, 64, 2))
    plan = plan_of(score(marked, layout, initial_parameters(layout)))
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
