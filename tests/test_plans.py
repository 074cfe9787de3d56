"""Plan shape: what reaches the scan, and how often rows are exchanged."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators.encode import apply_dictionary, fit_dictionary
from riskloom.operators.metrics import rank_score
from riskloom.operators.ordered import last_difference
from riskloom.operators.profile import profile
from riskloom.plans import ensemble
from riskloom.plans.features import statement_profiles
from riskloom.queries import QUERIES, informed_members
from riskloom.session import materialize


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan))


@pytest.fixture(scope="module")
def orders(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/orders.parquet")


@pytest.mark.parametrize("layout", ["wide", "long"])
def test_profile_exchanges_each_row_once(orders, layout):
    made = profile(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"], layout=layout)
    assert exchanges(plan_of(made)) == 1
    both = profile(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"], ["o_orderstatus"], layout=layout)
    assert exchanges(plan_of(both)) == 1


def scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("types", [["double"], ["double", "bigint"], ["double", "bigint", "decimal(12,2)", "decimal(20,4)"]])
def test_one_scan_and_one_exchange_for_everything(orders, types):
    rows = orders.withColumns({f"n{i}": F.col("o_totalprice").cast(t) for i, t in enumerate(types)})
    made = statement_profiles(
        rows, "o_custkey", "o_orderdate", ["o_orderkey"], [f"n{i}" for i in range(len(types))], ["o_orderstatus", "o_orderpriority"],
        markers=["n0", "o_orderstatus"], with_gaps=True, float32=False,
    )
    plan = plan_of(made)
    assert exchanges(plan) == 1 and scans(plan) == 1
    assert "Join" not in plan and len(re.findall(r"\bSort \[", plan)) <= 2  # rows by key and order; texts by cell


def test_small_dictionaries_join_nothing_and_large_ones_meet_once(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/lineitem.parquet").withColumn("id", F.monotonically_increasing_id())
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_partkey", "l_suppkey", "l_orderkey"]
    dictionary = materialize(fit_dictionary(rows, columns))
    small = plan_of(apply_dictionary(rows, dictionary, columns, unseen=-1, key="id"))
    assert exchanges(small) == 0 and "Join" not in small
    many = plan_of(apply_dictionary(rows, dictionary, columns, unseen=-1, broadcast_bytes=5_000, key="id"))
    one = plan_of(apply_dictionary(rows, dictionary, [*columns[:5], "l_orderkey"], unseen=-1, broadcast_bytes=5_000, key="id"))
    # Two, three or one large dictionaries: the plan has the same joins and exchanges.
    assert exchanges(many) == exchanges(one) and len(re.findall("Join", many)) == len(re.findall("Join", one))


def test_search_moves_rows_a_few_times(spark, sf_small):
    rows = informed_members(spark, sf_small)
    near = ensemble._candidates(rows, "label", "m1", "m2", "id", 0.001, 100)
    assert near.spread(list(range(101))).count() <= 2 * rows.count()
    far = ensemble._candidates(rows, "label", "m1", "m4", "id", 1.0, 20)
    best = ensemble.search_best(rows, "label", "m1", "m4", "id", 1.0, 20)
    moved = sum(far.spread(part).count() for part in (best.ordered[:1], best.ordered))
    assert len(best.ordered) < 21 and moved < 10 * rows.count()


def test_profile_reads_only_what_it_uses(orders):
    plan = plan_of(profile(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_orderpriority" not in read and "o_orderstatus" not in read


def test_last_difference_limits_rows_before_the_exchange(orders):
    plan = plan_of(last_difference(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]))
    assert exchanges(plan) == 1
    assert re.search(r"WindowGroupLimit .* 2, Partial", plan)


def test_rank_score_orders_rows_in_buckets(orders):
    df = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_totalprice"
    )
    plan = plan_of(rank_score(df, "label", "o_totalprice", "id"))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One orders rows within buckets; the other orders bucket totals.
    assert len(windows) == 2
    assert all(re.search(r"windowspecdefinition\(_bucket", w) for w in windows)
    assert "_of_rank" in windows[1] and "SortMergeJoin" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(_bucket[^,]*, \d+\)", plan)) == 3


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    plan = plan_of(QUERIES["filter_positive"](spark, sf_small))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_tax:double>", plan)
    assert "GreaterThan(l_tax,0.0)" in plan


SQL_FREE_OF = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"]


@pytest.mark.parametrize("name", ["profile_lineitem", "gap_profile", "rank_score_by_group", "encode_apply", "stack_matrix", "blend_grid"])
def test_no_cross_joins_and_no_python(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert [bad for bad in SQL_FREE_OF if bad in plan] == []
