"""The forest's grid and the folds of rescoring."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ionweave.operators import rescoring
from ionweave.operators.rescoring import GRID, Setting


def test_grid():
    assert len(GRID) == 35 and len(set(GRID)) == 35 and len({(s.depth, s.target_weight) for s in GRID}) == 25
    assert sorted({s.target_weight for s in GRID}) == [0.01, 0.1, 1.0, 10.0, 100.0]


def test_choice_follows_accuracy(spark):
    """Classes that need depth: a checkerboard; a stump's settings lose, and weights that drown a class lose."""
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 4, (1200, 2))
    rows = [(i // 3, [float(a), float(b)], float((int(a) + int(b)) % 2)) for i, (a, b) in enumerate(xy)]
    learn = spark.createDataFrame(rows, "query_id int, v array<double>, label double").select("query_id", array_to_vector("v").alias("x"), "label")
    grid = [Setting(1, None), Setting(9, ("1", "100")), Setting(9, None), Setting(9, ("2", "2"))]
    found = rescoring.grid_accuracy(learn, grid)
    assert found[grid[2]] > 0.85 and found[grid[0]] < 0.7 and found[grid[2]] == found[grid[3]]  # weights of one ratio share a fit
    assert rescoring.choose(learn, grid) == grid[2]  # the first among equals


def test_no_fold_sees_its_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i % 120, bool(rng.random() < 0.4), float(rng.normal()), 0.0) for i in range(900)]
    rows = [(i, q, d, c + (0 if d else 2), c * 3 + (0 if d else 1)) for i, q, d, c, _ in rows]
    ssms = spark.createDataFrame(rows, "ssm_id int, query_id int, is_decoy boolean, cosine double, f double")
    seen, fits = [], []

    def choose(learn, grid, seed):
        seen.append({r[0] for r in learn.select("query_id").distinct().collect()})
        return Setting(3, None)

    class Forest:
        def __init__(self, setting, trees, seed):
            pass

        def fit(self, learn):
            fits.append({r[0] for r in learn.select("query_id").distinct().collect()})
            return self

        def transform(self, rest):
            mine = {r[0] for r in rest.select("query_id").distinct().collect()}
            assert not mine & fits[-1] and not mine & seen[(len(fits) - 1) % 3]
            return rest.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.col("cosine"))))

    monkeypatch.setattr(rescoring, "choose", choose)
    monkeypatch.setattr(rescoring, "forest", Forest)
    out = rescoring.rescore(ssms, ["cosine", "f"], "rf", 0.3, rounds=2)
    assert out.count() == 900 and len(seen) == 3 and len(fits) == 6  # chosen once a fold, fitted in each round


def test_forest_separates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 90, bool(i % 3 == 0), float(rng.normal() + (i % 3 > 0)), float(rng.normal() + 4 * (i % 3 > 0))) for i in range(600)]
    ssms = spark.createDataFrame(rows, "ssm_id int, query_id int, is_decoy boolean, cosine double, f double")
    out = rescoring.rescore(ssms, ["cosine", "f"], "rf", 0.3, rounds=1, grid=[Setting(3, None), Setting(5, ("1", "10"))]).toPandas()
    auc = lambda c: (out[c].rank()[~out["is_decoy"]].sum() - 400 * 401 / 2) / (400 * 200)
    assert auc("score") > 0.93 > 0.8 > auc("cosine")
