"""Registered queries over the given tables, each with its SQL where SQL can state it.

Roles: ``orders`` are statements of customers (date, then order key, gives the
row order), ``lineitem`` are wide statements of orders, ``events`` have times of
day. An order's label is whether its status is F; its score is its scaled price.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.functions.arith import bernoulli_loss, clip, linear_blend, round_half_even, two_way_mix, weighted_average
from riskloom.functions.columns import project
from riskloom.functions.missing import fill_sentinel, null_counts, sentinel_fill
from riskloom.operators import derive
from riskloom.operators.casting import downcast_by_range, downcast_fixed, downcast_floats
from riskloom.operators.encode import apply_dictionary, fit_dictionary, load_dictionary, save_dictionary
from riskloom.operators.folds import (
    assign_chunks,
    balanced_grouped_folds,
    contiguous_folds,
    grouped_stratified_folds,
    holdout_split,
    repeated_stratified_folds,
    rows_of_chunks,
    stratified_folds,
)
from riskloom.operators.metrics import (
    RankScoreEvaluator,
    confusion_counts,
    fold_summary,
    log_loss,
    rank_score,
    rank_weighted_gradients,
    rank_weighted_log_loss,
)
from riskloom.operators.ordered import gap_days, last_difference
from riskloom.operators.ordering import head_tail, with_sequence
from riskloom.operators.profile import categorical_profile, numeric_profile, profile, tenure
from riskloom.plans.ensemble import (
    EPS,
    FIRST_MIX_WEIGHT,
    apply_blend,
    blend_grid,
    blend_moments,
    blend_objective,
    fit_blend,
    mix_and_search,
    score_matrix,
    search_best,
    stack,
    stack_until_settled,
)
from riskloom.plans.features import statement_profiles, training_frame, with_labels
from riskloom.plans.chunks import read_chunks, score_chunks, selected_columns, with_chunks, write_chunks
from riskloom.plans.learn import (
    ModelBundle,
    apply_meta_feature,
    average_folds,
    boosted_trees,
    cross_validate,
    early_stopping_stages,
    neural_stages,
    statement_meta_feature,
)
from riskloom.plans.selection import permutation_importance, select_features, selected_names
from riskloom.session import materialize, prepare, scratch
from riskloom.sources.files import attach, read_csv, read_parquet, write_csv, write_names

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, keep: Column | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", keep)


def rounded(digits: int, *names: str) -> list[Column]:
    return [round_half_even(F.col(f"`{n}`").cast("double"), digits).alias(n) for n in names]


def settled(digits: int, *names: str) -> list[Column]:
    """Rounded averages and deviations, stable under the order of summation.

    A mean of cents often lies exactly between two rounded values. The nudge of
    1 % of the last digit decides such ties; the SQL side adds the same.
    """
    nudge = F.lit(0.01 * 10.0**-digits)
    return [round_half_even(F.col(n).cast("double") + nudge, digits).alias(n) for n in names]


def settled_sql(value: str, digits: int = 4) -> str:
    return f"round_even({value} + {0.01 * 10.0**-digits!r}::DOUBLE, {digits})"


# --- shared inputs ---------------------------------------------------------------------

STATEMENTS = """
statements AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS price,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount,
         o_orderstatus AS status,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS from_end
  FROM orders)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers, with missing amounts and priorities."""
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
    )


ORDER = ["o_orderdate", "o_orderkey"]

SCORED = """
scored AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         round_even(o_totalprice / 500000, 2) AS score, o_totalprice / 250000 - 1 AS raw,
         o_orderpriority AS grp
  FROM orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled orders with a score that has many ties, and a raw score."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        round_half_even(F.col("o_totalprice") / 500000, 2).alias("score"),
        (F.col("o_totalprice") / 250000 - 1).alias("raw"),
        F.col("o_orderpriority").alias("grp"),
    )


# Three model scores inside (0.05, 0.95).
MEMBERS = """
members AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         0.05 + 0.9 * (o_totalprice / 500000) AS m1,
         0.05 + 0.9 * ((o_orderkey % 1009) / 1009.0::DOUBLE) AS m2,
         0.05 + 0.9 * ((o_custkey % 101) / 101.0::DOUBLE) AS m3
  FROM orders)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (F.lit(0.05) + F.lit(0.9) * (F.col("o_totalprice") / 500000)).alias("m1"),
        (F.lit(0.05) + F.lit(0.9) * ((F.col("o_orderkey") % 1009) / F.lit(1009.0))).alias("m2"),
        (F.lit(0.05) + F.lit(0.9) * ((F.col("o_custkey") % 101) / F.lit(101.0))).alias("m3"),
    )


# --- projections, filters, scalar expressions --------------------------------------------


@register(
    "project_features",
    "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return project(
        rows,
        keep=["l_quantity", "l_orderkey", "l_extendedprice", "l_discount"],
        drop=["l_orderkey", "l_shipdate"],
    )


@register(
    "filter_positive",
    "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax > 0.0",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", keep=F.col("l_tax") > 0.0).select("l_orderkey", "l_linenumber", "l_tax")


@register(
    "sentinel_fill",
    """
    WITH raw AS (
      SELECT o_orderkey,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount,
             CASE o_orderkey % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
                                 WHEN 2 THEN '-Infinity'::DOUBLE ELSE o_totalprice END AS odd
      FROM orders)
    SELECT o_orderkey, coalesce(amount, -127.0) AS amount,
           CASE WHEN isnan(odd) OR isinf(odd) THEN -127.0 ELSE odd END AS odd
    FROM raw""",
)
def _(spark, sf_dir):
    rest = F.col("o_orderkey") % 5
    odd = (
        F.when(rest == 0, F.lit(float("nan")))
        .when(rest == 1, F.lit(float("inf")))
        .when(rest == 2, F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice"))
    )
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"), odd.alias("odd")
    )
    return sentinel_fill(raw, ["amount", "odd"])


@register(
    "round2_features",
    """
    SELECT o_orderkey, price_first, price_last, preds, round_even(price_first, 2) AS price_first_round2,
           round_even(price_last, 2) AS price_last_round2, round_even(preds, 1) AS preds_round1
    FROM (SELECT o_orderkey, o_totalprice / 8 AS price_first, o_totalprice / 3000 AS price_last,
                 o_totalprice / 500000 AS preds FROM orders)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 8).alias("price_first"),
        (F.col("o_totalprice") / 3000).alias("price_last"),
        (F.col("o_totalprice") / 500000).alias("preds"),
    )
    return derive.round_features(rows).withColumn("preds_round1", round_half_even(F.col("preds"), 1))


def _amount_profile(spark, sf_dir) -> DataFrame:
    return numeric_profile(
        with_sequence(statements(spark, sf_dir), "o_custkey", ORDER), "o_custkey", ["price", "amount"]
    )


AMOUNT_PROFILE = f"""
WITH {STATEMENTS}, prof AS (
  SELECT o_custkey,
         arg_min(price, seq) AS price_first, avg(price) AS price_mean, arg_max(price, seq) AS price_last,
         arg_min(amount, seq) FILTER (amount IS NOT NULL) AS amount_first, avg(amount) AS amount_mean,
         arg_max(amount, seq) FILTER (amount IS NOT NULL) AS amount_last
  FROM statements GROUP BY o_custkey)
"""


@register(
    "last_mean_diff",
    AMOUNT_PROFILE
    + f"""SELECT o_custkey, {settled_sql('price_last - price_mean')} AS price_last_mean_diff,
                 {settled_sql('amount_last - amount_mean')} AS amount_last_mean_diff FROM prof""",
)
def _(spark, sf_dir):
    made = derive.last_mean_diff(_amount_profile(spark, sf_dir))
    return made.select("o_custkey", *settled(4, "price_last_mean_diff", "amount_last_mean_diff"))


@register(
    "last_mean_rate",
    """
    WITH prof AS (
      SELECT l_orderkey, l_discount AS disc_last, l_tax AS disc_mean, l_quantity AS qty_last,
             CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS qty_mean
      FROM lineitem)
    SELECT l_orderkey,
           CASE WHEN disc_mean = 0 AND disc_last = 0 THEN -1 WHEN disc_mean = 0 THEN -2
                ELSE round_even(disc_last / disc_mean, 6) END AS disc_last_mean_rate,
           round_even(qty_last / qty_mean, 8) AS qty_last_mean_rate
    FROM prof""",
)
def _(spark, sf_dir):
    prof = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_discount").alias("disc_last"),
        F.col("l_tax").alias("disc_mean"),
        F.col("l_quantity").alias("qty_last"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("qty_mean"),
    )
    made = derive.last_mean_rate(prof)
    rate = F.col("disc_last_mean_rate")
    shown = F.when(F.isnan(rate), F.lit(-1.0)).when(rate == F.lit(float("inf")), F.lit(-2.0)).otherwise(round_half_even(rate, 6))
    return made.select("l_orderkey", shown.alias("disc_last_mean_rate"), *rounded(8, "qty_last_mean_rate"))


@register(
    "last_first_diff",
    AMOUNT_PROFILE
    + f"""SELECT o_custkey, {settled_sql('price_last - price_first')} AS price_last_first_diff,
                 {settled_sql('amount_last - amount_first')} AS amount_last_first_diff FROM prof""",
)
def _(spark, sf_dir):
    made = derive.last_first_diff(_amount_profile(spark, sf_dir))
    return made.select("o_custkey", *settled(4, "price_last_first_diff", "amount_last_first_diff"))


@register(
    "pair_features",
    """
    SELECT l_orderkey, round_even(l_tax - l_discount, 6) AS "B_9-P_2", round_even(l_tax * l_discount, 6) AS "B_9XP_2",
           round_even(l_tax - l_quantity, 6) AS "B_9-P_3", round_even(l_tax * l_quantity, 6) AS "B_9XP_3",
           round_even(l_extendedprice - l_discount, 6) AS "S_16-P_2", round_even(l_extendedprice * l_discount, 6) AS "S_16XP_2",
           round_even(l_extendedprice - l_quantity, 6) AS "S_16-P_3", round_even(l_extendedprice * l_quantity, 6) AS "S_16XP_3"
    FROM lineitem""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_tax").alias("B_9"),
        F.col("l_extendedprice").alias("S_16"),
        F.col("l_discount").alias("P_2"),
        F.col("l_quantity").alias("P_3"),
    )
    made = derive.pair_features(rows, derive.PAY_BEFORE, derive.PAY_AFTER)
    names = [f"{b}{op}{p}" for b in ("B_9", "S_16") for p in ("P_2", "P_3") for op in ("-", "X")]
    return made.select("l_orderkey", *rounded(6, *names))


# Ratio inputs made from lineitem columns; some denominators are exactly zero.
RATIO_INPUTS = {
    "D_39": "l_quantity", "P_2": "l_discount", "B_9": "l_tax", "R_1": "l_discount - l_tax", "B_23": "l_quantity * l_tax",
    "B_3": "l_extendedprice / 1000", "B_33": "l_quantity / 10", "B_18": "l_tax * 2", "S_25": "l_discount * 3",
    "B_19": "l_quantity / 4", "B_20": "l_tax + l_discount", "B_4": "l_extendedprice / 500", "R_3": "l_tax / 2",
    "R_2": "l_quantity / 50", "R_4": "l_discount / 4", "D_62": "l_extendedprice / 300", "D_112": "l_quantity + 1",
    "R_27": "l_tax + 1", "D_48": "l_discount * 7", "P_3": "l_quantity / 25", "D_55": "l_tax * 9", "P_4": "l_tax - 0.0001",
}


@register(
    "ratio_features",
    "WITH base AS (SELECT l_orderkey, "
    + ", ".join(f"({e.replace('0.0001', '0.0001::DOUBLE')})::DOUBLE AS {n}" for n, e in RATIO_INPUTS.items())
    + """ FROM lineitem), made AS (
      SELECT l_orderkey,
        D_39 / (-P_2 + 0.0001::DOUBLE) AS c_PD_239, -P_2 / (B_9 + 0.0001::DOUBLE) AS c_PB_29,
        -P_2 / (R_1 + 0.0001::DOUBLE) AS c_PR_21, (B_9 + 0.001::DOUBLE) / (B_23 + B_3 + 0.0001::DOUBLE) AS c_BBBB,
        -B_33 + -B_18 + S_25 + 0.0001::DOUBLE AS c_BBBB1, B_19 + B_20 + B_4 + 0.0001::DOUBLE AS c_BBBB2,
        (R_3 + 0.001::DOUBLE) / (R_2 + R_4 + 0.0001::DOUBLE) AS c_RRR0,
        (D_62 + 0.001::DOUBLE) / (D_112 + R_27 + 0.0001::DOUBLE) AS c_RRR1,
        D_48 / (P_3 + 0.0001::DOUBLE) AS c_PD_348, D_55 / (P_3 + 0.0001::DOUBLE) AS c_PD_355,
        D_39 / (P_4 + 0.0001::DOUBLE) AS c_PD_439, B_9 / (P_4 + 0.0001::DOUBLE) AS c_PB_49,
        R_1 / (P_4 + 0.0001::DOUBLE) AS c_PR_41
      FROM base)
    SELECT l_orderkey, """
    + ", ".join(
        f"CASE WHEN isnan({n}) OR isinf({n}) THEN -127 ELSE round_even({n}, 5) END AS {n}" for n in derive.NAMED_RATIOS
    )
    + " FROM made",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    base = rows.select("l_orderkey", *[F.expr(f"CAST({e.replace('0.0001', '0.0001D')} AS DOUBLE)").alias(f"{n}_last") for n, e in RATIO_INPUTS.items()])
    made = derive.ratio_features(base)
    return made.select(
        "l_orderkey", *[round_half_even(fill_sentinel(F.col(n)), 5).alias(n) for n in derive.NAMED_RATIOS]
    )


@register(
    "date_parse",
    "SELECT o_orderkey, o_orderdate AS parsed FROM orders",
)
def _(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_timestamp_ntz(text).alias("parsed"))


@register(
    "downcast_fixed",
    """
    SELECT l_orderkey + 3000000000 AS l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity,
           CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_tax AS FLOAT) AS l_tax
    FROM lineitem""",
)
def _(spark, sf_dir):
    # Counts are narrowed, keys beyond the smaller type are not.
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 3_000_000_000).alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_quantity", "l_extendedprice", "l_tax",
    )
    return downcast_fixed(rows, integers=["l_linenumber"])


@register(
    "downcast_floats",
    "SELECT event_id, CAST(value AS FLOAT) AS value FROM events",
)
def _(spark, sf_dir):
    return downcast_floats(table(spark, sf_dir, "events").select("event_id", "value"))


@register(
    "downcast_by_range",
    """
    SELECT CAST(l_linenumber AS TINYINT) AS tiny, CAST(l_linenumber * 1000 AS SMALLINT) AS small,
           CAST(l_linenumber * 1000000 AS INTEGER) AS medium, l_linenumber::BIGINT * 1000000000000 AS large,
           CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_extendedprice AS FLOAT) AS l_extendedprice, l_returnflag
    FROM lineitem""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("tiny"),
        *[(F.col("l_linenumber").cast("long") * n).alias(c) for c, n in (("small", 1000), ("medium", 10**6), ("large", 10**12))],
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
    )
    return downcast_by_range(rows)


@register(
    "blend_scores",
    f"""
    WITH {MEMBERS}
    SELECT id, round_even(0.5 * m1 + 0.3 * m2 + 0.2 * m3, 10) AS blend,
           round_even((1 - 0.03221084221328546) * m1 + 0.03221084221328546 * m2, 10) AS mix,
           round_even((2 * m1 + 3 * m2 + 4 * m3) / 9, 10) AS average
    FROM members""",
)
def _(spark, sf_dir):
    return members(spark, sf_dir).select(
        "id",
        round_half_even(linear_blend({"m1": 0.5, "m2": 0.3, "m3": 0.2}), 10).alias("blend"),
        round_half_even(two_way_mix(F.col("m1"), F.col("m2"), FIRST_MIX_WEIGHT), 10).alias("mix"),
        round_half_even(weighted_average(["m1", "m2", "m3"], [2, 3, 4]), 10).alias("average"),
    )


# --- joins ---------------------------------------------------------------------------------


@register(
    "label_left",
    """
    SELECT doc_id, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return with_labels(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@register(
    "label_inner",
    """
    WITH lab AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target FROM customer)
    SELECT o_orderkey, o_custkey, o_totalprice, target FROM orders JOIN lab USING (o_custkey)""",
)
def _(spark, sf_dir):
    target = F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("target")
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), target)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(labels, "o_custkey")


@register(
    "chunk_assign",
    """
    SELECT o_custkey, CAST(ntile(7) OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS chunk
    FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def _(spark, sf_dir):
    return assign_chunks(table(spark, sf_dir, "orders"), "o_custkey", 7)


@register(
    "chunk_semi",
    """
    WITH chunks AS (SELECT o_custkey, ntile(7) OVER (ORDER BY o_custkey) - 1 AS chunk
                    FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM chunks WHERE chunk IN (1, 4))""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows_of_chunks(rows, assign_chunks(rows, "o_custkey", 7), "o_custkey", [1, 4])


@register(
    "chunk_union",
    """
    SELECT o_orderkey, o_custkey, round_even(0.05 + 0.9 * o_totalprice / 500000, 10) AS prediction FROM orders""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    chunks = assign_chunks(rows, "o_custkey", 2)
    parts = [rows_of_chunks(rows, chunks, "o_custkey", [i]) for i in range(2)]
    prediction = round_half_even(F.lit(0.05) + F.lit(0.9) * F.col("o_totalprice") / 500000, 10).alias("prediction")
    return reduce(DataFrame.unionByName, [p.select("o_orderkey", "o_custkey", prediction) for p in parts])


STACKED = [f"preds_{i}" for i in range(1, 16)]


@register(
    "stack_matrix",
    "SELECT o_orderkey AS id, "
    + ", ".join(f"(o_orderkey * {37 * i + 11}) % 1009 / 1009.0::DOUBLE AS preds_{i}" for i in range(1, 16))
    + " FROM orders WHERE o_orderkey % 11 <> 0",
)
def _(spark, sf_dir):
    model = F.explode(F.sequence(F.lit(1), F.lit(15))).alias("i")
    long = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), model)
    score = (F.col("id") * (37 * F.col("i") + 11)) % 1009 / F.lit(1009.0)
    # Model 3 lacks some ids; those drop out of the matrix.
    long = long.where((F.col("i") != 3) | (F.col("id") % 11 != 0))
    long = long.select("id", F.concat(F.lit("preds_"), F.col("i")).alias("model"), score.alias("p"))
    return score_matrix(long, "id", "model", "p", STACKED)


# --- profiles --------------------------------------------------------------------------------


def _numeric_sql(c: str, diff: bool, digits: int = 4) -> str:
    some = f"FILTER ({c} IS NOT NULL)"
    stats = {
        "first": f"arg_min({c}, seq) {some}",
        "mean": f"avg({c})",
        "std": f"stddev_samp({c})",
        "min": f"min({c})",
        "max": f"max({c})",
        "last": f"arg_max({c}, seq) {some}",
    }
    if diff:
        stats["diff1"] = f"max({c}) FILTER (from_end = 1) - max({c}) FILTER (from_end = 2)"
    return ", ".join(f"{settled_sql(e, digits)} AS {c}_{s}" for s, e in stats.items())


def _categorical_sql(c: str) -> str:
    some = f"FILTER ({c} IS NOT NULL)"
    return (
        f"count({c}) AS {c}_count, arg_min({c}, seq) {some} AS {c}_first, "
        f"arg_max({c}, seq) {some} AS {c}_last, count(DISTINCT {c}) AS {c}_nunique"
    )


NUMERIC_NAMES = [f"{c}_{s}" for c in ("price", "amount") for s in ("first", "mean", "std", "min", "max", "last")]


@register(
    "profile_numeric",
    f"""
    WITH {STATEMENTS}
    SELECT o_custkey, {_numeric_sql("price", False)}, {_numeric_sql("amount", False)}
    FROM statements GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    return _amount_profile(spark, sf_dir).select("o_custkey", *settled(4, *NUMERIC_NAMES))


@register(
    "profile_categorical",
    f"""
    WITH {STATEMENTS}
    SELECT o_custkey, {_categorical_sql("status")}, {_categorical_sql("priority")}
    FROM statements GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    rows = with_sequence(statements(spark, sf_dir), "o_custkey", ORDER)
    return categorical_profile(rows, "o_custkey", ["status", "priority"])


@register(
    "profile_full",
    f"""
    WITH {STATEMENTS}
    SELECT o_custkey, {_numeric_sql("price", True)}, {_numeric_sql("amount", True)},
           {_categorical_sql("status")}, {_categorical_sql("priority")}
    FROM statements GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    made = profile(statements(spark, sf_dir), "o_custkey", ORDER, ["price", "amount"], ["status", "priority"])
    numeric = [*NUMERIC_NAMES, "price_diff1", "amount_diff1"]
    return made.select("o_custkey", *settled(4, *numeric), *[c for c in made.columns if c.startswith(("status", "priority"))])


GAP = "coalesce((epoch_us({t}) - lag(epoch_us({t})) OVER (PARTITION BY {k} ORDER BY {t}, {i})) / 86400e6, 30.53)"

LINE_ORDER = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORIES = ["l_returnflag", "l_linestatus"]


@register(
    "profile_lineitem",
    f"""
    WITH statements AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS seq,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(f"{c} DESC" for c in LINE_ORDER)}) AS from_end
      FROM lineitem)
    SELECT l_orderkey, {", ".join(_numeric_sql(c, True) for c in LINE_NUMBERS)},
           {", ".join(_categorical_sql(c) for c in LINE_CATEGORIES)}
    FROM statements GROUP BY l_orderkey""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    made = profile(rows, "l_orderkey", LINE_ORDER, LINE_NUMBERS, LINE_CATEGORIES, layout="long")
    texts = [c for c in made.columns if c.startswith(tuple(LINE_CATEGORIES))]
    return made.select("l_orderkey", *settled(4, *[c for c in made.columns if c not in texts and c != "l_orderkey"]), *texts)


# Many columns of mixed types: every one is a stated shift of a table column.
WIDE_COLUMNS = {f"c{i}": (["l_partkey", "l_linenumber", "l_quantity", "l_tax"][i % 4], i) for i in range(24)}
WIDE_WHOLE = [c for c, (base, _) in WIDE_COLUMNS.items() if base in ("l_partkey", "l_linenumber")]
WIDE_EXACT = ["first", "last", "min", "max", "diff1"]


@register(
    "profile_wide",
    f"""
    WITH shifted AS (
      SELECT *, {", ".join(f"{base} + {i if base[2:] != 'partkey' else i + 9007199254740992} AS {c}" for c, (base, i) in WIDE_COLUMNS.items())}
      FROM lineitem),
    statements AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS seq,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(f"{c} DESC" for c in LINE_ORDER)}) AS from_end
      FROM shifted)
    SELECT l_orderkey, {", ".join(
        (f"arg_min({c}, seq)::BIGINT AS {c}_first, arg_max({c}, seq)::BIGINT AS {c}_last, min({c})::BIGINT AS {c}_min, "
         f"max({c})::BIGINT AS {c}_max, (max({c}) FILTER (from_end = 1) - max({c}) FILTER (from_end = 2))::BIGINT AS {c}_diff1")
        if c in WIDE_WHOLE else _numeric_sql(c, True) for c in WIDE_COLUMNS
    )}
    FROM statements GROUP BY l_orderkey""",
)
def _(spark, sf_dir):
    shift = {c: F.col(base) + F.lit(i + 2**53 if base == "l_partkey" else i) for c, (base, i) in WIDE_COLUMNS.items()}
    rows = table(spark, sf_dir, "lineitem").withColumns(shift)
    made = profile(rows, "l_orderkey", LINE_ORDER, list(WIDE_COLUMNS))
    whole = [f"{c}_{s}" for c in WIDE_WHOLE for s in WIDE_EXACT]
    rest = [c for c in made.columns[1:] if c.split("_")[0] not in WIDE_WHOLE]
    return made.select("l_orderkey", *whole, *settled(4, *rest))


@register(
    "profile_text_time",
    f"""
    WITH {STATEMENTS}, days AS (
      SELECT *, {GAP.format(t='o_orderdate', k='o_custkey', i='o_orderkey')} AS "SDist" FROM statements)
    SELECT o_custkey, {_numeric_sql("price", True)}, {_numeric_sql("SDist", True)}, {_categorical_sql("status")},
           count(o_orderdate)::DOUBLE AS "LT", max(o_orderdate) AS o_orderdate
    FROM days GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    # Text dates without leading zeros sort differently as text.
    text = statements(spark, sf_dir).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-M-d"))
    made = statement_profiles(
        text, "o_custkey", "o_orderdate", ["o_orderkey"], ["price"], ["status"], markers=["price"], with_gaps=True, float32=False
    )
    numbers = [c for c in made.columns if c.startswith(("price", "SDist"))]
    texts = [c for c in made.columns if c.startswith("status")]
    return made.select("o_custkey", *settled(4, *numbers), *texts, "LT", "o_orderdate")


@register(
    "last_diff",
    f"""
    WITH {STATEMENTS}
    SELECT o_custkey,
           round_even(max(price) FILTER (from_end = 1) - max(price) FILTER (from_end = 2), 4) AS price_diff1,
           round_even(max(amount) FILTER (from_end = 1) - max(amount) FILTER (from_end = 2), 4) AS amount_diff1
    FROM statements GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    made = last_difference(statements(spark, sf_dir), "o_custkey", ORDER, ["price", "amount"])
    return made.select("o_custkey", *rounded(4, "price_diff1", "amount_diff1"))


@register(
    "gap_days",
    f"""
    SELECT event_id, user_id, round_even({GAP.format(t="ts", k="user_id", i="event_id")}, 8) AS "SDist" FROM events""",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return gap_days(events, "user_id", "ts", ["event_id"]).select("event_id", "user_id", *rounded(8, "SDist"))


@register(
    "gap_profile",
    f"""
    WITH {STATEMENTS}, gaps AS (
      SELECT o_custkey, seq, from_end, {GAP.format(t="o_orderdate", k="o_custkey", i="o_orderkey")} AS "SDist"
      FROM statements)
    SELECT o_custkey, {_numeric_sql("SDist", True)} FROM gaps GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    # Dates arrive as text here, as in the raw statement files.
    text = statements(spark, sf_dir).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = gap_days(text, "o_custkey", "o_orderdate", ["o_orderkey"])
    made = profile(rows, "o_custkey", ORDER, ["SDist"])
    return made.select("o_custkey", *settled(4, *[c for c in made.columns if c.startswith("SDist")]))


@register(
    "tenure",
    """
    WITH k AS (
      SELECT l_orderkey, count(l_shipdate) AS n, max(l_shipdate) AS l_shipdate,
             count(nullif(l_tax, 0)) AS a, count(nullif(l_discount, 0)) AS b
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN n = 1 AND (a = 0 OR b = 0) THEN 0.5 ELSE n::DOUBLE END AS "LT", l_shipdate FROM k""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_shipdate",
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("B_3"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("D_104"),
    )
    return tenure(rows, "l_orderkey", "l_shipdate", ["B_3", "D_104"])


@register(
    "training_profiles",
    f"""
    WITH {STATEMENTS}, lab AS (
      SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target FROM customer),
    prof AS (
      SELECT o_custkey, arg_max(price, seq) AS price_last, avg(price) AS price_mean, arg_min(price, seq) AS price_first,
             max(price) FILTER (from_end = 1) - max(price) FILTER (from_end = 2) AS price_diff1,
             arg_max(status, seq) AS status_last, count(o_orderdate) AS n
      FROM statements GROUP BY o_custkey),
    codes AS (SELECT status_last, row_number() OVER (ORDER BY status_last) - 1 AS code
              FROM (SELECT DISTINCT status_last FROM prof))
    SELECT o_custkey, target, {settled_sql('price_last')} AS price_last, {settled_sql('price_diff1')} AS price_diff1,
           {settled_sql('price_last - price_mean')} AS price_last_mean_diff,
           round_even(price_last / price_mean, 6) AS price_last_mean_rate,
           {settled_sql('price_last - price_first')} AS price_last_first_diff, code AS status_last, n::DOUBLE AS "LT"
    FROM prof JOIN codes USING (status_last) LEFT JOIN lab USING (o_custkey)""",
)
def _(spark, sf_dir):
    target = F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("target")
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), target)
    made = statement_profiles(
        statements(spark, sf_dir),
        "o_custkey",
        "o_orderdate",
        ["o_orderkey"],
        ["price"],
        ["status"],
        markers=["price"],
        with_gaps=True,
        float32=False,
    )
    frame, _dictionary = training_frame(with_labels(made, labels, "o_custkey"), ["status_last"])
    four = ["price_last", "price_diff1", "price_last_mean_diff", "price_last_first_diff"]
    return frame.select(
        "o_custkey", "target", *settled(4, *four), *rounded(6, "price_last_mean_rate"), "status_last", "LT"
    )


@register(
    "null_counts",
    """
    SELECT count(*) FILTER (o_orderkey % 7 = 0) AS amount, count(*) FILTER (o_orderkey % 5 = 0) AS priority,
           0::BIGINT AS o_orderdate, count(*) FILTER (o_orderkey % 7 = 0) + count(*) FILTER (o_orderkey % 5 = 0) AS total
    FROM orders""",
)
def _(spark, sf_dir):
    return null_counts(statements(spark, sf_dir), ["amount", "priority", "o_orderdate"])


@register(
    "head_tail",
    """
    (SELECT o_orderkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)
    UNION ALL
    (SELECT o_orderkey, o_totalprice, 'tail' AS part FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return head_tail(rows, ["o_totalprice", "o_orderkey"], 5)


# --- encoding --------------------------------------------------------------------------------


def _encode_inputs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag")
    return rows.select(flag, F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), "l_orderkey")


MANY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_shipdate"]

CODES = "row_number() OVER (ORDER BY {0} NULLS LAST) - 1"


@register(
    "encode_fit",
    f"""
    WITH base AS (
      SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status,
             l_linenumber AS line, l_orderkey FROM lineitem)
    """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, {CODES.format(c)} AS code FROM (SELECT DISTINCT {c} FROM base)"
        for c in ("flag", "status", "line", "l_orderkey")
    ),
)
def _(spark, sf_dir):
    return fit_dictionary(_encode_inputs(spark, sf_dir), ["flag", "status", "line", "l_orderkey"])


@register(
    "encode_apply",
    """
    WITH seen AS (SELECT l_linestatus AS v, row_number() OVER (ORDER BY l_linestatus) - 1 AS code
                  FROM (SELECT DISTINCT l_linestatus FROM lineitem)),
    pri AS (SELECT v, row_number() OVER (ORDER BY v NULLS LAST) - 1 AS code
            FROM (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders))
    SELECT o_orderkey, coalesce(seen.code, -1) AS status, pri.code AS priority
    FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p
          FROM orders) o
    LEFT JOIN seen ON seen.v = o.o_orderstatus JOIN pri ON pri.v IS NOT DISTINCT FROM o.p""",
)
def _(spark, sf_dir):
    rows = statements(spark, sf_dir).select("o_orderkey", "status", "priority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"))
    coded = apply_dictionary(rows, fit_dictionary(lines, ["status"]), ["status"], unseen=-1)
    return apply_dictionary(coded, fit_dictionary(rows, ["priority"]), ["priority"])


@register(
    "encode_large_ids",
    """
    WITH base AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN -9007199254740992 - o_orderkey
                                       ELSE 9007199254740992 + o_orderkey END AS big FROM orders)
    SELECT 'big' AS feature, big::VARCHAR AS value, row_number() OVER (ORDER BY big) - 1 AS code FROM base""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    big = F.when(key % 3 == 0, F.lit(-(2**53)) - key).otherwise(F.lit(2**53) + key)
    return fit_dictionary(table(spark, sf_dir, "orders").select(big.alias("big")), ["big"])


@register(
    "encoder_roundtrip",
    """
    WITH codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
                   FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority NOT LIKE '1%'))
    SELECT o_orderkey, coalesce(code, -1) AS priority FROM orders LEFT JOIN codes ON v = o_orderpriority""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    with scratch(spark) as path:
        save_dictionary(fit_dictionary(rows.where("priority not like '1%'"), ["priority"]), path)
        return materialize(apply_dictionary(rows, load_dictionary(spark, path), ["priority"], unseen=-1))


@register(
    "submission_roundtrip",
    f"""
    WITH {MEMBERS}
    SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE round_even(m1, 8) END AS prediction FROM members""",
)
def _(spark, sf_dir):
    rows = members(spark, sf_dir)
    with scratch(spark) as path:
        write_csv(rows.select("id"), f"{path}/ids")
        wanted = read_csv(spark, f"{path}/ids", "id long")
        scored = rows.where("id % 4 != 0").select("id", F.col("m1").alias("prediction"))
        write_csv(attach(wanted, scored, "id"), f"{path}/submission")
        back = materialize(read_csv(spark, f"{path}/submission", "id long, prediction double"))
    return back.select("id", *rounded(8, "prediction"))


# --- folds -----------------------------------------------------------------------------------

DIGEST = "md5(concat('{seed}', ':', {id}))"


@register(
    "fold_stratified",
    f"""
    WITH {SCORED}
    SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', id)), id) - 1) % 5
                           AS INTEGER) AS fold
    FROM scored""",
)
def _(spark, sf_dir):
    return stratified_folds(scored(spark, sf_dir).select("id", "label"), "id", "label", 5)


@register(
    "fold_repeated",
    f"""
    WITH {SCORED}
    SELECT id, label, CAST(r AS INTEGER) AS repeat,
           CAST((row_number() OVER (PARTITION BY r, label ORDER BY md5(concat(42 + r, ':', id)), id) - 1) % 5
                AS INTEGER) AS fold
    FROM scored CROSS JOIN (SELECT unnest([0, 1]) AS r)""",
)
def _(spark, sf_dir):
    return repeated_stratified_folds(scored(spark, sf_dir).select("id", "label"), "id", "label", 5, repeats=2)


@register(
    "fold_contiguous",
    "SELECT o_orderkey AS id, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def _(spark, sf_dir):
    return contiguous_folds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 5)


@register(
    "fold_grouped",
    """
    WITH g AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS y FROM orders GROUP BY o_custkey),
    f AS (SELECT o_custkey, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat('42', ':', o_custkey)), o_custkey) - 1)
                                 % 5 AS INTEGER) AS fold FROM g)
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, fold
    FROM orders JOIN f USING (o_custkey)""",
)
def _(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label)
    return grouped_stratified_folds(rows, "o_custkey", "label", 5)


@register(
    "fold_grouped_balanced",
    """
    WITH RECURSIVE g AS (
      SELECT o_custkey % 97 * (o_custkey % 97) // 90 AS grp, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderkey FROM orders),
    s AS (SELECT grp, max(y) AS y, count(*) AS n, md5(concat('42', ':', grp)) AS d FROM (SELECT grp, CASE WHEN grp % 3 = 0 THEN 0 ELSE y END AS y FROM g) GROUP BY grp),
    placed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, d, grp) AS place FROM s),
    lpt AS (
      SELECT y, 0::BIGINT AS place, NULL::BIGINT AS grp, NULL::BIGINT AS fold, [0::BIGINT, 0, 0, 0, 0] AS loads FROM (SELECT DISTINCT y FROM s)
      UNION ALL
      SELECT p.y, p.place, p.grp, list_position(l.loads, list_min(l.loads)) - 1,
             list_transform(l.loads, lambda x, i: CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN x + p.n ELSE x END)
      FROM lpt l JOIN placed p ON p.y = l.y AND p.place = l.place + 1 AND p.place <= 8),
    filled AS (SELECT y, loads FROM lpt QUALIFY row_number() OVER (PARTITION BY y ORDER BY place DESC) = 1),
    rest AS (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY d, grp ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY y) AS total
             FROM placed WHERE place > 8),
    levels AS (SELECT r.*, loads, list_min([(total + list_sum(list_sort(loads)[1:j])) / j::DOUBLE for j in [1, 2, 3, 4, 5]]) AS level FROM rest r JOIN filled f ON f.y = r.y),
    room AS (SELECT *, [greatest(0.0, level - x) for x in loads] AS room FROM levels),
    folds AS (
      SELECT grp, fold FROM lpt WHERE grp IS NOT NULL
      UNION ALL
      SELECT grp, len(list_filter([list_sum(room[1:f]) for f in [1, 2, 3, 4]], lambda e: before >= e)) FROM room)
    SELECT o_orderkey, grp, CASE WHEN grp % 3 = 0 THEN 0 ELSE y END AS label, CAST(fold AS INTEGER) AS fold FROM g JOIN folds USING (grp)""",
)
def _(spark, sf_dir):
    # Groups of very different sizes.
    member = F.col("o_custkey") % 97
    label = F.when((F.col("o_orderstatus") == "F") & (F.col("grp") % 3 != 0), 1).otherwise(0).alias("label")
    rows = table(spark, sf_dir, "orders").withColumn("grp", F.floor(member * member / 90)).select("o_orderkey", "grp", label)
    return balanced_grouped_folds(rows, "grp", "label", 5, large=8)


@register(
    "encode_many",
    """
    WITH base AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS l_returnflag,
             l_linestatus, l_quantity, l_discount, l_tax, l_shipdate::VARCHAR AS l_shipdate, l_extendedprice
      FROM lineitem),
    """
    + ", ".join(
        f"k_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c} NULLS LAST) - 1 AS code FROM (SELECT DISTINCT {c} FROM base))"
        for c in MANY
    )
    + " SELECT l_extendedprice, "
    + ", ".join(f"k_{c}.code AS {c}" for c in MANY)
    + " FROM base b "
    + " ".join(f"JOIN k_{c} ON k_{c}.v IS NOT DISTINCT FROM b.{c}" for c in MANY),
)
def _(spark, sf_dir):
    # Keys and days are large dictionaries here, all others small.
    rows = table(spark, sf_dir, "lineitem").select(*MANY, "l_extendedprice")
    rows = rows.withColumns({"l_returnflag": F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")), "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")})
    return apply_dictionary(rows, fit_dictionary(rows, MANY), MANY, broadcast_bytes=20_000)


@register(
    "holdout_split",
    f"""
    WITH {SCORED}
    SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', id)), id)
                      <= floor(0.3 * count(*) OVER (PARTITION BY label)) AS is_holdout
    FROM scored""",
)
def _(spark, sf_dir):
    return holdout_split(scored(spark, sf_dir).select("id", "label"), "id", "label", 0.3)


# --- metrics ---------------------------------------------------------------------------------

# The best Gini is computed from a second ordering here, not from its closed form.
RANKED = """
weighted AS (SELECT *, CASE WHEN label = 0 THEN 20 ELSE 1 END AS w FROM {source}),
ranked AS (
  SELECT *, row_number() OVER s AS rank, count(*) OVER g AS n, sum(w) OVER g AS tw, sum(label) OVER g AS tp,
         sum(w) OVER (s ROWS UNBOUNDED PRECEDING) AS cw, sum(label) OVER (s ROWS UNBOUNDED PRECEDING) AS cp,
         sum(w) OVER (b ROWS UNBOUNDED PRECEDING) AS bw, sum(label) OVER (b ROWS UNBOUNDED PRECEDING) AS bp
  FROM weighted
  WINDOW g AS ({by}), s AS ({by} ORDER BY {score} DESC, id), b AS ({by} ORDER BY label DESC, id)),
metric AS (
  SELECT {keys} sum(label) FILTER (cw <= floor(0.04 * tw)) / max(tp)::DOUBLE AS d,
         sum((cp / tp::DOUBLE - cw / tw::DOUBLE) * w) / sum((bp / tp::DOUBLE - bw / tw::DOUBLE) * w) AS g
  FROM ranked {group})
"""


def ranked_sql(source: str, score: str, by: str = "") -> str:
    return RANKED.format(
        source=source,
        score=score,
        by=f"PARTITION BY {by}" if by else "",
        keys=f"{by}," if by else "",
        group=f"GROUP BY {by}" if by else "",
    )


@register(
    "top_capture",
    f"WITH {SCORED}, {ranked_sql('scored', 'score')} SELECT round_even(d, 8) AS top_capture FROM metric",
)
def _(spark, sf_dir):
    return rank_score(scored(spark, sf_dir), "label", "score", "id").select(*rounded(8, "top_capture"))


@register(
    "weighted_gini",
    f"WITH {SCORED}, {ranked_sql('scored', 'score')} SELECT round_even(g, 8) AS weighted_gini FROM metric",
)
def _(spark, sf_dir):
    return rank_score(scored(spark, sf_dir), "label", "score", "id").select(*rounded(8, "weighted_gini"))


@register(
    "rank_score",
    f"""
    WITH {SCORED}, {ranked_sql('scored', 'score')}
    SELECT round_even(0.5 * (g + d), 8) AS rank_score FROM metric""",
)
def _(spark, sf_dir):
    return rank_score(scored(spark, sf_dir), "label", "score", "id").select(*rounded(8, "rank_score"))


@register(
    "rank_score_by_group",
    f"""
    WITH {SCORED}, {ranked_sql('scored', 'score', 'grp')}
    SELECT grp, round_even(d, 8) AS top_capture, round_even(g, 8) AS weighted_gini, round_even(0.5 * (g + d), 8) AS rank_score
    FROM metric""",
)
def _(spark, sf_dir):
    made = rank_score(scored(spark, sf_dir), "label", "score", "id", by=["grp"])
    return made.select("grp", *rounded(8, "top_capture", "weighted_gini", "rank_score"))


@register(
    "rank_score_documents",
    f"""
    WITH scored AS (
      SELECT d.doc_id AS id, l.quality AS label, n_chars / 1000.0::DOUBLE AS score
      FROM documents d JOIN labels l USING (doc_id)), {ranked_sql('scored', 'score')}
    SELECT round_even(d, 8) AS top_capture, round_even(g, 8) AS weighted_gini FROM metric""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return rank_score(docs.join(labels, "id"), "label", "score", "id").select(*rounded(8, "top_capture", "weighted_gini"))


@register(
    "metric_evaluator",
    f"""
    WITH {SCORED}, {ranked_sql('scored', 'score')}
    SELECT round_even(0.5 * (g + d), 8) AS rank_score, true AS larger_better FROM metric""",
)
def _(spark, sf_dir):
    evaluator = RankScoreEvaluator(labelCol="label", predictionCol="score", idCol="id")
    value = evaluator.evaluate(scored(spark, sf_dir))
    return spark.createDataFrame([(round(value, 8), evaluator.isLargerBetter())], "rank_score double, larger_better boolean")


FALLING = "1 + exp(-5.0 * (2.0 - 1) * (1 - (rank - 1) / (n - 1)::DOUBLE))"


@register(
    "rank_weighted_grad",
    f"""
    WITH {SCORED}, {ranked_sql('scored', 'raw')},
    p AS (SELECT *, 1 / (1 + exp(-raw)) AS p,
                 CASE WHEN label = 1 AND cw > floor(0.04 * tw) THEN {FALLING} ELSE 1 END AS weight FROM ranked)
    SELECT id, rank, round_even(weight, 8) AS weight,
           round_even(p * (1 + weight * label - label) - weight * label, 8) AS grad,
           round_even(greatest(p * (1 - p) * (1 + weight * label - label), 1e-16), 8) AS hess
    FROM p""",
)
def _(spark, sf_dir):
    made = rank_weighted_gradients(scored(spark, sf_dir), "label", "raw", "id")
    return made.select("id", "rank", *rounded(8, "weight", "grad", "hess"))


@register(
    "rank_weighted_logloss",
    f"""
    WITH {SCORED}, {ranked_sql('scored', 'raw')},
    p AS (SELECT *, 1 / (1 + exp(-raw)) AS p, {FALLING} AS weight FROM ranked)
    SELECT round_even(avg(-weight * label * ln(p) - (1 - label) * ln(1 - p)), 8) AS rank_weighted_log_loss FROM p""",
)
def _(spark, sf_dir):
    made = rank_weighted_log_loss(scored(spark, sf_dir), "label", "raw", "id")
    return made.select(*rounded(8, "rank_weighted_log_loss"))


@register(
    "log_loss",
    f"""
    WITH {MEMBERS}
    SELECT round_even(avg(-(label * ln(m1) + (1 - label) * ln(1 - m1))), 8) AS log_loss FROM members""",
)
def _(spark, sf_dir):
    return log_loss(members(spark, sf_dir), "label", "m1").select(*rounded(8, "log_loss"))


@register(
    "confusion_counts",
    f"""
    WITH {MEMBERS}
    SELECT label, count(*) FILTER (m1 < 0.5) AS pred_0, count(*) FILTER (m1 >= 0.5) AS pred_1
    FROM members GROUP BY label""",
)
def _(spark, sf_dir):
    predicted = members(spark, sf_dir).withColumn("pred", (F.col("m1") >= 0.5).cast("int"))
    return confusion_counts(predicted, "label", "pred")


@register(
    "fold_summary",
    f"""
    WITH {SCORED}, folded AS (
      SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', id)), id) - 1) % 5 AS fold
      FROM scored), {ranked_sql('folded', 'score', 'fold')}
    SELECT round_even(avg(0.5 * (g + d)), 8) AS cv_mean, round_even(stddev_pop(0.5 * (g + d)), 8) AS cv_std, count(*) AS folds
    FROM metric""",
)
def _(spark, sf_dir):
    folded = materialize(stratified_folds(scored(spark, sf_dir).select("id", "label", "score"), "id", "label", 5))
    made = fold_summary(rank_score(folded, "label", "score", "id", by=["fold"]), "rank_score")
    return made.select(*rounded(8, "cv_mean", "cv_std"), "folds")


# --- model workflow ----------------------------------------------------------------------------

ORDER_FEATURES = ["price", "amount", "month", "priority_code"]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement-grain model rows: one per order."""
    return statements(spark, sf_dir).select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("status") == "F", 1).otherwise(0).alias("label"),
        "price",
        "amount",
        F.month("o_orderdate").cast("double").alias("month"),
        F.substring("priority", 1, 1).cast("double").alias("priority_code"),
    )


CUSTOMER_FEATURES = ["price_mean", "price_std", "price_min", "price_max", "amount_last", "LT"]


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-grain model rows: profiles with a label from the account balance."""
    made = statement_profiles(
        statements(spark, sf_dir), "o_custkey", "o_orderdate", ["o_orderkey"], ["price", "amount"], [], markers=["price"]
    )
    label = F.when(F.col("c_acctbal") < 2500, 1).otherwise(0).alias("label")
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), label)
    return made.join(labels, "o_custkey").select("o_custkey", "label", *CUSTOMER_FEATURES)


def _small_trees() -> list:
    return [boosted_trees(rounds=4, depth=3)]


def _customer_cv(spark, sf_dir, **options) -> ModelBundle:
    rows = customer_rows(spark, sf_dir)
    return cross_validate(rows, CUSTOMER_FEATURES, "label", "o_custkey", _small_trees, k=3, **options)


@register("cv_oof")
def _(spark, sf_dir):
    return _customer_cv(spark, sf_dir).oof


@register(
    "cv_oof_coverage",
    """
    WITH rows AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 2500 THEN 1 ELSE 0 END AS label
                  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT o_custkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', o_custkey)), o_custkey)
                                   - 1) % 3 AS INTEGER) AS fold, true AS is_probability
    FROM rows""",
)
def _(spark, sf_dir):
    oof = _customer_cv(spark, sf_dir).oof
    return oof.select("o_custkey", "label", "fold", F.col("prediction").between(0, 1).alias("is_probability"))


@register("cv_scores")
def _(spark, sf_dir):
    return _customer_cv(spark, sf_dir).scores


@register("cv_repeated")
def _(spark, sf_dir):
    rows = customer_rows(spark, sf_dir)
    return cross_validate(rows, CUSTOMER_FEATURES, "label", "o_custkey", _small_trees, k=2, repeats=2).oof


@register("neural_member")
def _(spark, sf_dir):
    rows = customer_rows(spark, sf_dir)
    stages = lambda: neural_stages(len(CUSTOMER_FEATURES), rounds=15)
    return cross_validate(rows, CUSTOMER_FEATURES, "label", "o_custkey", stages, k=2).oof


@register(
    "neural_early_stop",
    """
    WITH rows AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 2500 THEN 1 ELSE 0 END AS label
                  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT o_custkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', o_custkey)), o_custkey)
                                   - 1) % 2 AS INTEGER) AS fold, true AS is_probability, true AS least_is_kept, true AS at_most_two_worse
    FROM rows""",
)
def _(spark, sf_dir):
    rows = customer_rows(spark, sf_dir)
    stages = lambda: early_stopping_stages(len(CUSTOMER_FEATURES), stage_rounds=3, stages=8)
    bundle = cross_validate(rows, CUSTOMER_FEATURES, "label", "o_custkey", stages, k=2)
    # The loss of the kept weights, taken anew from the out-of-fold rows, next to the losses of all stages.
    kept = log_loss(bundle.oof, "label", "prediction", ["fold"])
    losses = [(f, i, float(x)) for f, m in enumerate(bundle.models) for i, x in enumerate(m.stages[-1].stage_losses)]
    stage = spark.createDataFrame(losses, "fold int, stage int, loss double")
    least = stage.groupBy("fold").agg(F.min("loss").alias("least"), F.min_by("stage", "loss").alias("chosen"), F.max("stage").alias("last"))
    judged = least.join(kept, "fold").select(
        "fold", (F.abs(F.col("log_loss") - F.col("least")) < 1e-9).alias("least_is_kept"), (F.col("last") - F.col("chosen") <= 2).alias("at_most_two_worse")
    )
    return bundle.oof.join(judged, "fold").select(
        "o_custkey", "label", "fold", F.col("prediction").between(0, 1).alias("is_probability"), "least_is_kept", "at_most_two_worse"
    )


CHUNKED_SQL = f"""
    WITH {STATEMENTS}, keys AS (
      SELECT o_custkey, CAST(ntile(7) OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS chunk FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_custkey, chunk, {_numeric_sql("price", True)}, {_categorical_sql("status")}, count(o_orderdate)::DOUBLE AS "LT"
    FROM statements JOIN keys USING (o_custkey) GROUP BY o_custkey, chunk"""


def chunked_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    made = statement_profiles(rows, "o_custkey", "o_orderdate", ["o_orderkey"], ["price"], ["status"], markers=["price"], float32=False)
    return with_chunks(made, rows, "o_custkey", 7)


@register("chunked_profiles_roundtrip", CHUNKED_SQL)
def _(spark, sf_dir):
    with scratch(spark) as path:
        write_chunks(chunked_profiles(spark, sf_dir), path)
        # Each chunk is read by itself, as a scoring job would.
        parts = [read_chunks(spark, path, [i]) for i in range(7)]
        back = materialize(reduce(DataFrame.unionByName, parts))
    numbers = [c for c in back.columns if c.startswith("price")]
    return back.select("o_custkey", "chunk", *settled(4, *numbers), *[c for c in back.columns if c.startswith("status")], "LT")


@register(
    "score_saved_bundle",
    """
    WITH keys AS (SELECT o_custkey, CAST(ntile(3) OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS chunk FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_custkey, chunk, true AS same FROM keys WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def _(spark, sf_dir):
    bundle = _customer_cv(spark, sf_dir)
    rows = with_chunks(customer_rows(spark, sf_dir), statements(spark, sf_dir), "o_custkey", 3)
    with scratch(spark) as path:
        bundle.save(f"{path}/bundle")
        write_chunks(rows, f"{path}/profiles")
        scored = score_chunks(read_chunks(spark, f"{path}/profiles"), f"{path}/bundle", CUSTOMER_FEATURES, "o_custkey")
        write_chunks(scored, f"{path}/scores")
        back = materialize(read_chunks(spark, f"{path}/scores"))
    direct = average_folds(bundle.models, rows, CUSTOMER_FEATURES).select("o_custkey", F.col("prediction").alias("direct"))
    same = F.abs(F.col("prediction") - F.col("direct")) < 1e-12
    return back.join(direct, "o_custkey").select("o_custkey", "chunk", same.alias("same"))


@register(
    "feature_list_roundtrip",
    """
    WITH rows AS (
      SELECT o_orderkey, o_totalprice AS price, substr(o_orderpriority, 1, 1)::DOUBLE AS priority_code,
             CASE WHEN o_totalprice > 250000 AND substr(o_orderpriority, 1, 1) <= '3' THEN 1 ELSE 0 END AS label
      FROM orders WHERE o_orderkey % 2 = 1)
    SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', o_orderkey)), o_orderkey) - 1) % 2 AS INTEGER) AS fold,
           'price,priority_code' AS features, 'priority_code' AS categorical
    FROM rows""",
)
def _(spark, sf_dir):
    # The label follows from two of the columns; importance finds them on one half of the orders, training uses them on the other.
    names = ["price", "month", "priority_code", "weekday"]
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("month"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority_code"), F.dayofweek("o_orderdate").cast("double").alias("weekday"),
    )
    rows = rows.withColumn("label", F.when((F.col("price") > 250000) & (F.col("priority_code") <= 3), 1).otherwise(0))
    trees = lambda: [boosted_trees(rounds=6, depth=4)]
    importance = materialize(permutation_importance(rows.where("o_orderkey % 2 = 0"), names, "label", "o_orderkey", trees, repeats=2))
    with scratch(spark) as path:
        chosen, categorical = selected_names(importance, ["priority_code", "weekday"], least=0.02)
        write_names(spark, sorted(chosen), path)
        kept, features = selected_columns(rows.where("o_orderkey % 2 = 1"), path, ["o_orderkey", "label"])
        oof = cross_validate(kept, features, "label", "o_orderkey", trees, k=2).oof
    placed = kept.join(oof.select("o_orderkey", "fold"), "o_orderkey")
    return placed.withColumns({"features": F.lit(",".join(features)), "categorical": F.lit(",".join(categorical))})


@register("bundle_roundtrip", "SELECT c_custkey AS o_custkey, true AS same FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    bundle = _customer_cv(spark, sf_dir)
    with scratch(spark) as path:
        bundle.save(path)
        loaded = ModelBundle.load(spark, path)
    rows = customer_rows(spark, sf_dir)
    before = average_folds(bundle.models, rows, CUSTOMER_FEATURES).select("o_custkey", F.col("prediction").alias("before"))
    after = average_folds(loaded.models, rows, CUSTOMER_FEATURES).select("o_custkey", F.col("prediction").alias("after"))
    same = F.abs(F.col("before") - F.col("after")) < 1e-12
    return before.join(after, "o_custkey").select("o_custkey", same.alias("same"))


@register("fold_inference")
def _(spark, sf_dir):
    rows = customer_rows(spark, sf_dir)
    return average_folds(_customer_cv(spark, sf_dir).models, rows, CUSTOMER_FEATURES).select("o_custkey", "prediction")


def _meta_feature(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    label = F.when(F.col("c_acctbal") < 2500, 1).otherwise(0).alias("target")
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), label)
    trees = lambda: [boosted_trees(rounds=3, depth=3, label="target")]
    return rows, statement_meta_feature(rows, labels, "o_custkey", "o_orderkey", "target", ORDER_FEATURES, trees, k=3)


@register("meta_feature_train")
def _(spark, sf_dir):
    return _meta_feature(spark, sf_dir)[1][0]


@register("meta_feature_apply")
def _(spark, sf_dir):
    rows, (_train, bundle) = _meta_feature(spark, sf_dir)
    return apply_meta_feature(bundle, rows, ORDER_FEATURES)


@register("stacking")
def _(spark, sf_dir):
    rows = members(spark, sf_dir)
    bundle, predictions = stack(rows, rows.drop("label"), ["m1", "m2", "m3"], "label", "id", k=3, rounds=3, depth=3)
    oof = bundle.oof.select("id", F.col("prediction").alias("oof_prediction"))
    return predictions.select("id", "prediction").join(oof, "id")


@register(
    "stacking_rounds",
    f"""
    WITH {MEMBERS}
    SELECT id, label, true AS loss_as_stated, true AS settled, true AS weights_bounded, 1.0::DOUBLE AS negative_weight FROM members""",
)
def _(spark, sf_dir):
    rows = members(spark, sf_dir)
    made = stack_until_settled(rows, rows.drop("label"), ["m1", "m2", "m3"], "label", "id", k=2, rounds=3, depth=3)
    # Loss and weights of every round, recomputed from its raw scores by their formulas, not by the operators that made them.
    order = Window.partitionBy("round").orderBy(F.col("raw").desc(), "id")
    n = F.count("*").over(Window.partitionBy("round"))
    ranked = made.rounds.withColumn("w", F.lit(1.0) + F.exp(F.lit(-5.0) * (F.lit(1.0) - (F.row_number().over(order) - 1) / (n - 1))))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("raw")))
    loss = -F.col("w") * F.col("label") * F.log(p) - (F.lit(1.0) - F.col("label")) * F.log(F.lit(1.0) - p)
    stated = spark.createDataFrame(list(enumerate(made.losses)), "round int, stated double")
    by_round = ranked.groupBy("round").agg(F.avg(loss).alias("loss")).join(stated, "round")
    checked = by_round.agg(
        F.bool_and(F.abs(F.col("loss") - F.col("stated")) < 1e-9).alias("loss_as_stated"),
        (F.abs(F.max_by("loss", "round") - F.max_by("loss", F.when(F.col("round") < len(made.losses) - 1, F.col("round")))) <= 0.01 * F.max_by("loss", "round")).alias("settled"),
    ).first()
    weights = made.rounds.groupBy("id", "label").agg(
        F.bool_and(F.col("weight").between(1, 2)).alias("weights_bounded"), F.max(F.when(F.col("label") == 0, F.col("weight")).otherwise(1.0)).alias("negative_weight")
    )
    return weights.select("id", "label", F.lit(checked.loss_as_stated).alias("loss_as_stated"), F.lit(checked.settled).alias("settled"), "weights_bounded", "negative_weight")


@register(
    "blend_objective",
    f"""
    WITH {MEMBERS}, folded AS (SELECT *, ntile(5) OVER (ORDER BY id) - 1 AS fold FROM members),
    b AS (SELECT label, fold, 0.5 * m1 + 0.3 * m2 + 0.2 * m3 AS b FROM folded)
    SELECT CAST(f AS INTEGER) AS fold, round_even(avg(-(label * ln(b) + (1 - label) * ln(1 - b))), 8) AS log_loss
    FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE fold <> f GROUP BY f""",
)
def _(spark, sf_dir):
    placed = contiguous_folds(members(spark, sf_dir), "id", 5)
    made = blend_objective(placed, "label", {"m1": 0.5, "m2": 0.3, "m3": 0.2}, 5)
    return made.select("fold", *rounded(8, "log_loss"))


@register("blend_fit")
def _(spark, sf_dir):
    fit = fit_blend(members(spark, sf_dir), ["m1", "m2", "m3"], "label", "id")
    rows = [(m, float(w)) for m, w in zip(["m1", "m2", "m3"], fit.weights, strict=True)]
    return spark.createDataFrame(rows, "model string, weight double")


WIDE_MEMBERS = [f"preds_{i}" for i in range(1, 16)]


@register(
    "blend_fit_wide",
    "WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, ntile(5) OVER (ORDER BY o_orderkey) - 1 AS fold, ["
    + ", ".join(f"0.05 + 0.9 * ((o_orderkey * {37 * i + 11}) % 1009 / 1009.0::DOUBLE)" for i in range(1, 16))
    + """] AS p FROM orders),
    d AS (SELECT y, fold, list_transform(p[1:14], lambda x: x - p[15]) AS d, list_sum(list_transform(p, lambda x, i: x * i / 120.0::DOUBLE)) AS b FROM m),
    each AS (SELECT f, d, -(y * ln(b) + (1 - y) * ln(1 - b)) AS loss, (b - y) / (b * (1 - b)) AS g, y / (b * b) + (1 - y) / ((1 - b) * (1 - b)) AS h
             FROM d, (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE f <> fold),
    places AS (SELECT i, j FROM (SELECT unnest(range(0, 15)) AS i), (SELECT unnest(range(0, 15)) AS j) WHERE j <= i)
    SELECT CAST(f AS INTEGER) AS fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
           round_even(avg(CASE WHEN i = 0 THEN loss WHEN j = 0 THEN g * d[i] ELSE h * d[i] * d[j] END), 8) AS moment
    FROM each, places GROUP BY f, i, j""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        *[(F.lit(0.05) + F.lit(0.9) * (F.col("o_orderkey") * (37 * i + 11) % 1009 / F.lit(1009.0))).alias(f"preds_{i}") for i in range(1, 16)],
    )
    weights = np.array([[i / 120.0 for i in range(1, 15)]] * 5)
    made = blend_moments(contiguous_folds(rows, "id", 5), WIDE_MEMBERS, "label", weights)
    # Row 0 is the loss, column 0 the slopes, the rest the packed curvature.
    places = [(0, 0), *[(i, 0) for i in range(1, 15)], *[(i, j) for i in range(1, 15) for j in range(1, i + 1)]]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("moments", F.lit(n)).alias("moment")) for n, (i, j) in enumerate(places)])
    return made.select(F.col("training").alias("fold"), F.explode(cells).alias("c")).select("fold", "c.i", "c.j", *rounded_of("c.moment", 8))


def rounded_of(name: str, digits: int) -> list[Column]:
    return [round_half_even(F.col(name), digits).alias(name.split(".")[-1])]


@register(
    "blend_grid",
    f"""
    WITH {MEMBERS}, scored AS (
      SELECT id, label, candidate, (1 - candidate * 0.001::DOUBLE / 100.0::DOUBLE) * m1
                                   + candidate * 0.001::DOUBLE / 100.0::DOUBLE * m2 AS score
      FROM members, (SELECT unnest(range(101)) AS candidate)), {ranked_sql('scored', 'score', 'candidate')}
    SELECT CAST(candidate AS INTEGER) AS candidate, round_even(candidate * 0.001::DOUBLE / 100.0::DOUBLE, 8) AS weight,
           round_even(0.5 * (g + d), 8) AS rank_score FROM metric""",
)
def _(spark, sf_dir):
    made = blend_grid(members(spark, sf_dir), "label", "m1", "m2", "id")
    return made.select("candidate", *rounded(8, "weight", "rank_score"))


@register(
    "blend_search_best",
    f"""
    WITH {MEMBERS}, scored AS (
      SELECT id, label, candidate, (1 - candidate * 1.0::DOUBLE / 20.0::DOUBLE) * m1
                                   + candidate * 1.0::DOUBLE / 20.0::DOUBLE * (0.75 * m2 + 0.2 * label) AS score
      FROM members, (SELECT unnest(range(21)) AS candidate)), {ranked_sql('scored', 'score', 'candidate')}
    SELECT CAST(candidate AS INTEGER) AS candidate, round_even(candidate * 1.0::DOUBLE / 20.0::DOUBLE, 8) AS weight,
           round_even(0.5 * (g + d), 8) AS rank_score FROM metric ORDER BY 0.5 * (g + d) DESC, candidate LIMIT 1""",
)
def _(spark, sf_dir):
    best = search_best(informed_members(spark, sf_dir), "label", "m1", "m4", "id", max_weight=1.0, steps=20)
    made = spark.createDataFrame([(best.candidate, best.weight, best.rank_score)], "candidate int, weight double, rank_score double")
    return made.select("candidate", *rounded(8, "weight", "rank_score"))


def informed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with a fourth one that knows something of the label."""
    return members(spark, sf_dir).withColumn("m4", F.lit(0.75) * F.col("m2") + F.lit(0.2) * F.col("label"))


@register("blend_search")
def _(spark, sf_dir):
    rows = members(spark, sf_dir)
    return mix_and_search(rows, rows, "label", "id", "m1", "m2", "m3", max_weight=1.0, steps=20)[2]


@register("blend_apply")
def _(spark, sf_dir):
    rows, names = members(spark, sf_dir), ["m1", "m2", "m3"]
    fit = fit_blend(rows, names, "label", "id")
    return apply_blend(rows, "id", names, fit.weights.tolist())


@register("permutation_importance")
def _(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    return permutation_importance(rows, ORDER_FEATURES, "label", "o_orderkey", _small_trees, repeats=2)


@register(
    "feature_selection",
    """
    WITH base AS (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_quantity, l_extendedprice, l_discount,
                         l_tax, l_linenumber::DOUBLE AS l_linenumber FROM lineitem),
    long AS (UNPIVOT base ON l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x),
    imp AS (SELECT feature, round_even(corr(x, y), 8) AS weight FROM long GROUP BY feature)
    SELECT feature, weight, feature IN ('l_linenumber', 'l_tax') AS is_categorical FROM imp WHERE weight >= 0""",
)
def _(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    base = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("y"), *[F.col(c).cast("double") for c in names]
    )
    long = base.unpivot(["y"], names, "feature", "x")
    importance = long.groupBy("feature").agg(round_half_even(F.corr("x", "y"), 8).alias("weight"))
    return select_features(importance, ["l_linenumber", "l_tax"])


@register(
    "rank_score_missing",
    f"""
    WITH {SCORED}, missing AS (
      SELECT id, label, CASE WHEN id % 2 = 0 THEN -1.0 ELSE score END AS score FROM scored), {ranked_sql('missing', 'score')}
    SELECT round_even(d, 8) AS top_capture, round_even(g, 8) AS weighted_gini, round_even(0.5 * (g + d), 8) AS rank_score FROM metric""",
)
def _(spark, sf_dir):
    rows = scored(spark, sf_dir)
    missing = rows.withColumn("score", F.when(F.col("id") % 2 != 0, F.col("score")))
    return rank_score(missing, "label", "score", "id").select(*rounded(8, "top_capture", "weighted_gini", "rank_score"))


@register(
    "blend_fit_check",
    "SELECT unnest(range(3))::INT AS fold, true AS is_minimum, true AS is_below_start",
)
def _(spark, sf_dir):
    # Some members are certain of some rows, and all of them of a few.
    rows = members(spark, sf_dir)
    sure = F.when(F.col("id") % 97 == 0, 0.0).when(F.col("id") % 89 == 0, 1.0)
    rows = rows.withColumns({"label": F.when(F.col("id") % 97 == 0, 0).otherwise(F.col("label")), "m1": F.coalesce(sure, "m1"),
                             "m2": F.when(F.col("id") % 97 == 0, 0.0).otherwise(F.col("m2"))})
    k, names = 3, ["m1", "m2"]
    fit = fit_blend(rows, names, "label", "id", k)
    placed = materialize(contiguous_folds(rows, "id", k))
    found = []
    for f in range(k):
        w = float(fit.fold_weights[f][0])
        tries = {"at": w, "start": 0.5, "less": w - 1e-4, "more": w + 1e-4}
        training = placed.where(F.col("fold") != f)
        losses = {n: F.avg(bernoulli_loss(F.col("label"), clip(linear_blend({"m1": x, "m2": 1.0 - x}), EPS, 1.0 - EPS))) for n, x in tries.items()}
        row = training.agg(*[v.alias(n) for n, v in losses.items()]).first()
        found.append((f, min(row.less, row.more) >= row.at - 1e-12, row.at <= row.start))
    return spark.createDataFrame(found, "fold int, is_minimum boolean, is_below_start boolean")


@register(
    "fold_inference_check",
    "SELECT c_custkey AS o_custkey, true AS same FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
def _(spark, sf_dir):
    rows, models = customer_rows(spark, sf_dir), _customer_cv(spark, sf_dir).models
    together = average_folds(models, rows, CUSTOMER_FEATURES).select("o_custkey", "prediction")
    for i, model in enumerate(models):
        own = average_folds([model], rows, CUSTOMER_FEATURES).select("o_custkey", F.col("prediction").alias(f"p{i}"))
        together = together.join(own, "o_custkey")
    mean = sum((F.col(f"p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return together.select("o_custkey", (F.abs(mean - F.col("prediction")) < 1e-9).alias("same"))


@register(
    "meta_profile",
    """
    WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT o_custkey, true AS is_between, 0 AS diff_columns FROM k WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def _(spark, sf_dir):
    # Statement-level predictions become profile columns like any other, without a last-step difference.
    rows = _meta_feature(spark, sf_dir)[1][0]
    dated = rows.join(statements(spark, sf_dir).select("o_orderkey", "o_orderdate"), "o_orderkey")
    made = profile(dated, "o_custkey", ["o_orderdate", "o_orderkey"], ["preds", "price"])
    # The mean of equal doubles may miss them by the last place.
    near = F.lit(1e-12)
    between = F.col("preds_mean").between(F.col("preds_min") - near, F.col("preds_max") + near) & F.col("preds_last").between(0, 1)
    return made.select("o_custkey", between.alias("is_between"), F.lit(sum("preds_diff" in c for c in made.columns)).alias("diff_columns"))
