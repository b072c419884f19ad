"""The registered index searches against brute force: at least 0.9 of the true neighbours."""

import os

import pytest

from ionweave.operators import ann
from ionweave.plans import catalogue


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("query", ["ivf_knn", "forest_knn"])
def test_registered_recall(spark, sf, query):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    recall = ann.recall(catalogue.QUERIES[query](spark, d), catalogue.QUERIES["exact_knn_topk"](spark, d))
    print(sf, recall)
    assert recall >= 0.9


def test_leaves_are_bounded(spark, tmp_path):
    """A third of the vectors are copies of one; leaves stay small."""
    import numpy as np
    from pyspark.sql import functions as F

    from ionweave.operators import forest

    v = np.random.default_rng(3).normal(size=(900, 8))
    v[600:] = v[0]
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "id int, vec array<double>")
    made = forest.build_forest(df, str(tmp_path / "f"), trees=3, leaf=50)
    sizes = made.part("leaves").groupBy("tree", "leaf").count()
    assert sizes.agg(F.max("count")).first()[0] <= 75 and sizes.groupBy("tree").agg(F.sum("count")).where("`sum(count)` != 900").count() == 0
    q = df.where("id in (1, 2, 3)")
    near = made.search(q, 1, beam=3).collect()
    assert {r["query_id"]: r["library_id"] for r in near} == {i: int(np.argmax(v @ v[i])) for i in (1, 2, 3)}


def test_forest_search_is_that_of_its_leaves(spark, tmp_path, monkeypatch):
    """Queries go once to a part of a tree, whatever the leaves they reach there; the result is that of the plain beam and all its leaves."""
    import numpy as np

    from ionweave.operators import forest

    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 6)).astype(np.float32)
    v[400:600] = v[:200]  # copies: equal scores, by id
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<float>")
    made, trees, beam, k = forest.build_forest(df, str(tmp_path / "f"), trees=3, leaf=12), 3, 5, 7
    monkeypatch.setattr(forest, "ASKED", 20)
    asked = df.where("id % 20 = 0")
    splits = {(r["tree"], r["node"]): r["at"] for r in made.part("splits").collect()}
    leaves = {}
    for r in made.part("leaves").collect():
        leaves.setdefault((r["tree"], r["leaf"]), []).append(r["id"])
    levels = made.part("shape").first()["levels"]
    assert levels > 5
    ways = forest.directions(trees, levels, 6, 42)
    lists = made.reached(asked, beam).collect()
    got = {(r["query_id"], r["rank"]): (r["library_id"], round(r["score"], 6)) for r in made.search(asked, k, beam).collect()}
    assert len({(r["id"], r["tree"], r["part"]) for r in lists}) == len(lists)  # one row a part
    for q in range(0, 900, 20):
        near = set()
        for tree in range(trees):
            at = [(0.0, 1)]
            for level in range(levels):
                some = []
                for cost, node in at:
                    if (tree, node) in splits:
                        gap = float(ways[tree, level] @ v[q].astype(float)) - splits[tree, node]
                        some += [(cost, node * 2 + (gap > 0)), (cost + gap * gap, node * 2 + 1 - (gap > 0))]
                at = sorted(some)[:beam]
            mine = sorted(x for r in lists if r["id"] == q and r["tree"] == tree for x in r["leaves"])
            assert mine == sorted(node for _, node in at)
            near |= {x for _, node in at for x in leaves.get((tree, node), ())}
        score = v.astype(float) @ v[q].astype(float)
        want = sorted(near, key=lambda x: (-round(score[x], 9), x))[:k]
        assert [got[q, r + 1] for r in range(len(want))] == [(x, round(float(score[x]), 6)) for x in want]
        assert (q, len(want) + 1) not in got


def test_forest_of_one_leaf(spark, tmp_path):
    from ionweave.operators import forest

    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "id long, vec array<double>")
    made = forest.build_forest(df, str(tmp_path / "f"), trees=2)
    got = made.search(df.where("id = 4"), 3).orderBy("rank").collect()
    assert [(r["library_id"], r["score"]) for r in got] == [(8, 33.0), (7, 29.0), (6, 25.0)]
