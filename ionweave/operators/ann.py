"""Nearest neighbours by inner product: exact, and through a stored inverted file of k-means cells by charge.

The inverted file is a folder of Parquet: library vectors by charge and lot of cells, sorted by cell, and the cells with
their centroids and sizes. It is built once for a library and a layout (``sources.versions``); a search reads the cells
that its queries probe and trains nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.operators import blocks
from ionweave.sources import versions

SAMPLE, LOTS, SHARD = 100_000, 256, 200_000  # vectors to train on; folders a charge; vectors of a cell in one task


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "library_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _schema(queries: DataFrame, library: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['id']}, library_id {dict(library.dtypes)['id']}, score double"


def exact_neighbours(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """``(query_id, library_id, score, rank)``: brute force over a stated query set, the yardstick of the index.

    Sides have ``id, vec``. Blocks of queries meet parts of the library; rows between stages are ``k`` a query and part.
    """
    queries, library = queries.select("id", "vec"), library.select("id", "vec")
    q, lib, n = blocks.dealt(queries, library, queries.count())
    return _top(blocks.meet(q, lib, ["block", "part"], blocks.top_k(k), _schema(queries, library), n), k)


def rank_of_other(queries: DataFrame, library: DataFrame) -> DataFrame:
    """``(query_id, rank)``: the place among all neighbours of the first one with another ``label``; both sides have ``id, vec, label``.

    Two passes in blocks: the best row of another label, then a count of rows before it. Nothing is sorted.
    """
    queries, library = queries.select("id", "vec", "label"), library.select("id", "vec", "label")
    of, kind = _schema(queries, library), dict(library.dtypes)["id"]
    asked = queries.count()
    q, lib, n = blocks.dealt(queries, library, asked)
    best = blocks.meet(q, lib, ["block", "part"], blocks.BestOther, of.replace(f"library_id {kind}, score double", f"score double, library_id {kind}"), n)
    goal = best.groupBy("query_id").agg(F.min_by(F.struct("score", "library_id"), F.struct((-F.col("score")).alias("o"), "library_id")).alias("g"))
    aimed = queries.join(goal, queries["id"] == goal["query_id"]).select("id", "vec", F.col("g.score").alias("goal_score"), F.col("g.library_id").alias("goal_id"))
    q, lib, n = blocks.dealt(aimed, library.select("id", "vec"), asked)
    return blocks.meet(q, lib, ["block", "part"], blocks.Above, f"query_id {dict(queries.dtypes)['id']}, n long", n).groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def train_cells(library: DataFrame, num_list: int, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """``(cell, centroid)``: k-means on at most about ``sample`` library vectors.

    Centroids have unit length: cells are chosen by inner product, and a long centroid would draw vectors of other cells.
    """
    total = library.count()
    part = library.sample(min(1.0, sample / max(total, 1)), seed) if total > sample else library
    model = KMeans(k=num_list, seed=seed, maxIter=12, featuresCol="features").fit(part.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    rows = [(i, [float(x) for x in c / (float(c @ c) ** 0.5 or 1.0)]) for i, c in enumerate(model.clusterCenters())]  # ``num_list`` rows
    return library.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def _assigned(vectors: DataFrame, centroids: dict[int, tuple[np.ndarray, np.ndarray]], cells: int) -> DataFrame:
    """``(id, vec, charge, cell)``: the ``cells`` nearest cells of each vector among those of its charge; none without an index."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)  # ``num_list`` centroids a charge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            charge, near = b.column(2).to_numpy(zero_copy_only=False), [[]] * b.num_rows
            for z in np.unique(charge).tolist():
                if z in sent.value:
                    names, c = sent.value[z]
                    at = np.flatnonzero(charge == z)
                    s = blocks.matrix(b.column(1).take(pa.array(at))) @ c.T
                    for i, order in zip(at.tolist(), np.argsort(-s, axis=1, kind="stable")[:, :cells]):
                        near[i] = names[order].tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near, pa.list_(pa.int32()))], ["id", "vec", "charge", "cells"])

    kinds = dict(vectors.dtypes)
    found = vectors.select("id", "vec", F.col("charge").cast("int").alias("charge")).mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, charge int, cells array<int>")
    return found.select("id", "vec", "charge", F.explode("cells").alias("cell"))


@dataclass(frozen=True)
class Index:
    """A stored inverted file."""

    spark: SparkSession
    path: str

    def cells(self) -> DataFrame:
        """``(charge, cell, centroid, n, shards)``."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        """``(id, vec, cell, shard, charge, lot)``; filters on ``charge`` and ``lot`` choose folders, one on ``cell`` row groups."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def charges(self) -> DataFrame:
        return self.cells().select("charge").distinct()

    def search(self, queries: DataFrame, k: int, num_probe: int) -> DataFrame:
        """``(query_id, library_id, score, rank)`` of ``queries(id, vec, charge)`` from the ``num_probe`` nearest cells of each.

        The cells that are probed at all are known first, so the others' files aren't read.
        """
        table = self.cells().collect()  # ``num_list`` rows a charge
        centroids = {}
        for z in {r["charge"] for r in table}:
            own = sorted((r["cell"], r["centroid"]) for r in table if r["charge"] == z)
            centroids[z] = (np.array([c for c, _ in own], np.int32), np.array([c for _, c in own]))
        probes = _assigned(queries, centroids, num_probe)
        asked = {(r["charge"], r["cell"]): r["n"] for r in probes.groupBy("charge", "cell").agg(F.count("*").alias("n")).collect()}  # at most a row a cell
        shards = {(r["charge"], r["cell"]): r["shards"] for r in table}
        shape = f"query_id {dict(queries.dtypes)['id']}, library_id {dict(self.vectors().dtypes)['id']}, score double"
        if not asked:
            return self.spark.createDataFrame([], f"{shape}, rank int")
        plan = self.spark.createDataFrame([(z, c, c // lot_size(len(centroids[z][0])), shards[z, c], -(-n // blocks.QUERIES)) for (z, c), n in asked.items()], "charge int, cell int, lot int, shards int, blocks int")
        plan = F.broadcast(plan)  # at most a row a cell
        lots: dict[int, set[int]] = {}
        for z, c in asked:
            lots.setdefault(z, set()).add(c // lot_size(len(centroids[z][0])))
        chosen = None
        for z, which in lots.items():
            one = (F.col("charge") == z) & F.col("lot").isin(sorted(which))
            chosen = one if chosen is None else chosen | one
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = probes.join(plan, ["charge", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("shard", each("shards"))
        lib = self.vectors().where(chosen).drop("lot").join(plan.drop("shards", "lot"), ["charge", "cell"]).withColumn("block", each("blocks"))
        keys = ["charge", "cell", "shard", "block"]
        tasks = sum(shards[key] * -(-n // blocks.QUERIES) for key, n in asked.items())
        return _top(blocks.meet(q.select(*keys, "id", "vec"), lib.select(*keys, "id", "vec"), keys, blocks.top_k(k), shape, min(tasks, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))), k)


def lot_size(cells: int) -> int:
    return -(-cells // LOTS)


def build_index(vectors: DataFrame, path: str, num_list: int, seed: int = 42) -> Index:
    """Writes the inverted file of ``vectors(id, vec, charge)``; charges of fewer than ``num_list`` vectors get none."""
    spark = vectors.sparkSession
    vectors = vectors.select("id", "vec", F.col("charge").cast("int").alias("charge"))
    many = sorted(r["charge"] for r in vectors.groupBy("charge").count().where(F.col("count") >= num_list).collect() if r["charge"] is not None)  # a row a charge
    trained = {z: train_cells(vectors.where(F.col("charge") == z), num_list, seed).orderBy("cell").collect() for z in many}
    centroids = {z: (np.array([r["cell"] for r in rows], np.int32), np.array([r["centroid"] for r in rows])) for z, rows in trained.items()}
    filed = _assigned(vectors.where(F.col("charge").isin(many)), centroids, 1)
    sizes = {(r["charge"], r["cell"]): r["count"] for r in filed.groupBy("charge", "cell").count().collect()}  # at most a row a cell
    cells = [(z, r["cell"], r["centroid"], sizes.get((z, r["cell"]), 0), max(1, -(-sizes.get((z, r["cell"]), 0) // SHARD))) for z, rows in trained.items() for r in rows]
    table = spark.createDataFrame(cells, "charge int, cell int, centroid array<double>, n long, shards int")
    sharded = filed.join(F.broadcast(table.select("charge", "cell", "shards")), ["charge", "cell"])
    sharded = sharded.select("id", "vec", "cell", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), "charge", F.floor(F.col("cell") / lot_size(num_list)).cast("int").alias("lot"))
    sharded.repartition("charge", "lot", "shard").sortWithinPartitions("charge", "lot", "cell").write.partitionBy("charge", "lot").parquet(f"{path}/vectors")
    table.coalesce(1).write.parquet(f"{path}/cells")
    return Index(spark, path)


def build_or_open(vectors: DataFrame, path: str, layout: str, source: str, num_list: int, seed: int = 42) -> Index:
    """The index at ``path`` if it has this layout and source, else a new version of it."""
    note = {"layout": layout, "source": source, "num_list": num_list, "seed": seed}
    return Index(vectors.sparkSession, versions.build_or_open(vectors.sparkSession, path, note, lambda at: build_index(vectors, at, num_list, seed)))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of true neighbours that were found."""
    hits = truth.join(found.select("query_id", "library_id"), ["query_id", "library_id"], "left_semi").count()
    return hits / max(truth.count(), 1)
