"""Approximate neighbours by a forest of random-projection trees, the second index beside the inverted file.

Each level of a tree has a random direction; a node splits at the median of its own vectors' projections, equal projections by a hash of the
id, so that copies spread over both sides and leaves stay at about ``leaf`` vectors. A vector's projections on all directions come from one
pass; then the levels are built one after the other from numbers alone: medians by node, one join, one step down.

A search goes down all trees with a beam: at each level the ``beam`` nodes of least squared distance to the planes on the way stay. The
leaves reached, united over trees, give the candidates, which are scored exactly: each query goes once to each part of a tree that it
reaches, with the list of its leaves there, and each vector once to its part of each tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.operators import blocks
from ionweave.sources import versions
from ionweave.sources.versions import cut

TREES, LEAF, BEAM, SHARE = 10, 64, 4, 16  # nodes kept at a level: ``BEAM`` at least, and one in ``SHARE`` leaves
LOTS, ASKED, HELD = 16, 16_384, 1_000_000  # tasks of a tree in the descent, queries of a part in a task, nodes held at a time


def directions(trees: int, levels: int, width: int, seed: int) -> np.ndarray:
    """Unit vectors by tree and level."""
    d = np.random.default_rng(seed).standard_normal((trees, levels, width))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def projected(vectors: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """``(id, tree, p)``: the projections of each vector on the levels of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = blocks.matrix(b.column(1))
                d = directions(trees, levels, v.shape[1], seed).reshape(trees * levels, v.shape[1]) if d is None else d
                p = (v @ d.T).reshape(len(v) * trees, levels)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(v)), trees)))
                ends = pa.array(np.arange(len(p) + 1) * levels, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(trees), len(v)), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["id", "tree", "p"])

    return vectors.select("id", "vec").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, tree int, p array<double>")


def part_level(levels: int) -> int:
    """The level whose nodes are the parts of a tree: 16 parts, or more of at most 2048 leaves."""
    return min(levels, max(4, levels - 11))


class Descent(blocks.Kernel):
    """Queries (``id, tree, p``) stream past the splits of one tree and go down it, the ``beam`` nodes of least cost at a level."""

    def __init__(self, splits: pa.Table, levels: int, beam: int):
        super().__init__(splits)
        self.levels, self.beam, self.tree = levels, beam, splits["tree"][0].as_py()
        level, node, at = (splits[c].to_numpy() for c in ("level", "node", "at"))
        self.at = [np.full(1 << k, np.nan) for k in range(levels)]  # none: a node without vectors
        for k, values in enumerate(self.at):
            values[node[level == k] - (1 << k)] = at[level == k]

    def down(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, their costs, infinite where there is none), a row a query."""
        node, cost = np.ones((len(p), 1), np.int64), np.zeros((len(p), 1))
        for level, values in enumerate(self.at):
            gap = p[:, level, None] - values[node - (1 << level)]
            near = (gap > 0).astype(np.int64)
            node, cost = np.hstack([node * 2 + near, node * 2 + 1 - near]), np.hstack([cost + 0 * gap, cost + gap * gap])
            cost[np.isnan(cost)] = np.inf
            if node.shape[1] > self.beam:
                keep = cost <= np.partition(cost, self.beam - 1, axis=1)[:, self.beam - 1, None]
                for k in np.flatnonzero(keep.sum(1) > self.beam):  # equal costs: by node
                    keep[k] = False
                    keep[k, np.lexsort((node[k], cost[k]))[: self.beam]] = True
                node, cost = node[keep].reshape(-1, self.beam), cost[keep].reshape(-1, self.beam)
        return node, cost

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p, size = blocks.matrix(rows.column("p")), max(1, HELD // self.beam)
        for lo in range(0, len(p), size):
            node, cost = self.down(p[lo : lo + size])
            own, column = np.nonzero(cost < np.inf)
            leaf = node[own, column]
            order = np.lexsort((leaf, own))
            own, leaf = own[order], leaf[order]
            part = leaf >> self.levels - part_level(self.levels)
            starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])])) if len(own) else np.empty(0, np.int64)
            leaves = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)), pa.int32()), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(own[starts] + lo)), pa.array(np.full(len(starts), self.tree), pa.int32()), pa.array(part[starts]), leaves], ["id", "tree", "part", "leaves"])

    def result(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class BestOfLeaves(blocks.Kernel):
    """The ``k`` rows of highest inner product of each query (``id, vec, leaves``) among those of its leaves; equal ones by ``id``. Rows come leaf by leaf."""

    k = 10

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        self.q = blocks.matrix(queries["vec"])
        self.exp, self.least = blocks.exponents(self.q), np.full(len(self.q), -np.inf)
        lists = queries["leaves"].combine_chunks()
        leaves, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.argsort(leaves, kind="stable")
        self.leaves, self.owner = leaves[order], owner[order]
        self.kept, self.new, self.held = None, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        leaf = rows.column("leaf").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        v, found = blocks.matrix(rows.column("vec")), []
        exp = blocks.exponents(v)
        for lo, hi in zip(edges, edges[1:]):
            a, b = np.searchsorted(self.leaves, [leaf[lo], leaf[lo] + 1])
            for at in range(a, b, blocks.QUERIES):
                who = self.owner[at : min(b, at + blocks.QUERIES)]
                s = blocks.products(self.q[who], v[lo:hi], self.exp[who], exp[lo:hi])
                i, j = np.nonzero(s >= self.least[who][:, None])  # an equal one may have a smaller id
                found.append((who[i], s[i, j], lo + j))
        if found:
            who, score, place = (np.concatenate(c) for c in zip(*found))
            self.new.append((who, score, rows.column("id").take(pa.array(place))))
            self.held += len(who)
            if self.held > HELD // 4:
                self._settle()

    def _settle(self) -> None:
        """Keeps the ``k`` best of each query."""
        parts = [*([self.kept] if self.kept else []), *self.new]
        who, score, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
        name = ids.to_numpy(zero_copy_only=False)
        order = np.lexsort((name.astype(str) if name.dtype == object else name, -score, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        order = order[rank < self.k]
        self.kept, self.new, self.held = (who[rank < self.k], score[order], ids.take(pa.array(order))), [], 0
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.kept[0][full]] = self.kept[1][full]

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self._settle()
        if self.kept:
            who, score, ids = self.kept
            yield pa.RecordBatch.from_arrays([self.queries["id"].combine_chunks().take(pa.array(who)), ids, pa.array(score)], ["query_id", "library_id", "score"])


def best_of_leaves(k: int):
    return type("BestOfLeaves", (BestOfLeaves,), {"k": k})


@dataclass(frozen=True)
class Forest:
    """A stored forest."""

    spark: SparkSession
    path: str

    def part(self, name: str) -> DataFrame:
        """``splits(level, tree, node, at)``, ``leaves(tree, leaf, id)``, ``vectors(id, vec)`` or ``shape(trees, levels, seed)``."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def reached(self, queries: DataFrame, beam: int) -> DataFrame:
        """``(id, tree, part, leaves)``: the leaves each query reaches, in lists by the part of the tree that they lie in.

        A tree's splits meet its queries in ``LOTS`` tasks, where the beam is an array: no row of a query and a node is made.
        """
        trees, levels, seed = self.part("shape").first()
        at = projected(queries, trees, levels, seed)
        if not levels:
            return at.select("id", "tree", F.lit(1).cast("long").alias("part"), F.array(F.lit(1).cast("long")).alias("leaves"))
        kind = dict(queries.dtypes)["id"]
        splits = self.part("splits").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))).withColumn("id", F.lit(None).cast(kind))
        lots = at.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(LOTS)).cast("int"))
        make = lambda table: Descent(table, levels, beam)
        return blocks.meet(splits, lots, ["tree", "lot"], make, f"id {kind}, tree int, part long, leaves array<long>")

    def search(self, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
        """``(query_id, library_id, score, rank)`` of ``queries(id, vec)`` among the candidates of their leaves.

        The beam grows with the number of leaves unless it is given: a fixed one finds less the more leaves there are.
        """
        beam = beam or max(BEAM, (1 << self.part("shape").first()["levels"]) // SHARE)
        kinds = dict(queries.dtypes)["id"], dict(self.part("vectors").dtypes)["id"]
        groups = max(1, -(-queries.count() // ASKED))
        reached = cut(self.reached(queries, beam))
        q = reached.join(queries.select("id", "vec"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        levels = self.part("shape").first()["levels"]
        lib = self.part("leaves").join(self.part("vectors"), "id").withColumn("part", F.shiftright("leaf", levels - part_level(levels)))
        lib = lib.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = blocks.meet(q, lib, ["tree", "part", "block"], best_of_leaves(k), f"query_id {kinds[0]}, library_id {kinds[1]}, score double", order=("leaf",))
        once = found.groupBy("query_id", "library_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "library_id")  # ``k`` a part of a tree
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_forest(vectors: DataFrame, path: str, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> Forest:
    """Writes the forest of ``vectors(id, vec)``."""
    spark = vectors.sparkSession
    vectors.select("id", "vec").write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    n, levels = stored.count(), 0
    while n > leaf << levels:
        levels += 1
    at = cut(projected(stored, trees, levels, seed).withColumn("node", F.lit(1).cast("long")))
    splits = None
    for level in range(levels):
        value = F.col("p")[level]
        own = cut(at.groupBy("tree", "node").agg(F.percentile_approx(value, 0.5, 10_000).alias("at")).withColumn("level", F.lit(level)))
        splits = own if splits is None else splits.unionByName(own)
        coin = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2))
        right = F.when(value > F.col("at"), 1).when(value < F.col("at"), 0).otherwise(coin)
        at = cut(at.join(own.drop("level"), ["tree", "node"]).select("id", "tree", "p", (F.col("node") * 2 + right).alias("node")))
    none = spark.createDataFrame([], "tree int, node long, at double, level int")
    (none if splits is None else splits).coalesce(1).write.parquet(f"{path}/splits")  # a row a node
    at.select("tree", F.col("node").alias("leaf"), "id").repartition("tree", "leaf").write.parquet(f"{path}/leaves")
    spark.createDataFrame([(trees, levels, seed)], "trees int, levels int, seed int").coalesce(1).write.parquet(f"{path}/shape")
    return Forest(spark, path)


def build_or_open(vectors: DataFrame, path: str, source: str, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> Forest:
    note = {"source": source, "trees": trees, "leaf": leaf, "seed": seed}
    return Forest(vectors.sparkSession, versions.build_or_open(vectors.sparkSession, path, note, lambda at: build_forest(vectors, at, trees, leaf, seed)))
