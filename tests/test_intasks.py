"""Work on the rows of one task: figures equal those of plain rows, and no interpreted row-by-row plan remains."""

import os
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from riskloom.plans import ensemble, intasks


def members(spark, n=400):
    rows = [(i % 350, i % 3 == 0 and 1 or 0, ((i * 37) % 101) / 101, ((i * 53) % 97) / 97 if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moments_are_summed_in_the_tasks(spark):
    df = members(spark).withColumn("fold", (F.col("id") % 2).cast("int"))
    made = ensemble.blend_moments(df, ["a", "b"], "y", np.array([[0.3], [0.6]]))
    # Exploding rows by fold and their products by lambdas took most of the time.
    text = plan(made)
    assert "MapInArrow" in text and "lambdafunction" not in text
    rows = [r for r in df.collect() if r.b is not None]
    for r in made.collect():
        own = [x for x in rows if x.fold != r.training]
        w = (0.3, 0.6)[r.training]
        blend = [min(max(x.b + w * (x.a - x.b), 1e-15), 1 - 1e-15) for x in own]
        loss = np.mean([-(x.y * np.log(b) + (1 - x.y) * np.log(1 - b)) for x, b in zip(own, blend, strict=True)])
        assert abs(r.moments[0] - loss) < 1e-9 and len(r.moments) == 3


def test_rows_are_placed_and_ordered_in_batches(spark):
    made = ensemble._candidates(members(spark), "y", "a", "b", "id", 1.0, 20)
    tried = list(range(21))
    assert "lambdafunction" not in plan(made.spread(tried))
    exact = made.exact(tried, made.totals(tried))
    assert "Window" not in plan(exact) and "applyInArrow" in plan(exact) or "FlatMapGroupsInArrow" in plan(exact)
    runs = made.spread(tried).groupBy("id", "a", "b").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("n"), F.count_if(F.col("start") == 0).alias("rows"))
    assert runs.where("n != 21 * rows").isEmpty()


def test_narrow_cells_bound_and_rule_out(spark):
    df = members(spark)
    made = ensemble._candidates(df, "y", "a", "b", "id", 1.0, 20)
    tried = list(range(21))
    want = {r.candidate: r.rank_score for r in ensemble.blend_grid(df, "y", "a", "b", "id", 1.0, 20).collect()}
    closer, wide = made.upper(tried), made.bounds(made.totals(tried))[1]
    assert all(want[c] - 1e-9 <= closer[c] <= wide[c] + 1e-9 for c in tried)


def test_functions_load_without_the_package(tmp_path):
    placing = intasks.Placing(("a", "b"), 1.0, 4, 0.0, 1.0, 8)
    cells = np.arange(8)
    shipped = [
        intasks.moment_sums(np.zeros((2, 1)), 1e-15), intasks.runs(placing, cells, [0, 1]), intasks.counts(placing, cells, [0, 1], "y"),
        intasks.ordered(placing, "id", "y", [0], np.zeros((1, 8)), 20, 100, 4),
    ]
    path = tmp_path / "shipped"
    path.write_bytes(cloudpickle.dumps(shipped))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb')); assert 'riskloom' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
