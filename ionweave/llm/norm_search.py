"""Exact top-k inner products: vectors by falling length, bounds from rotated partial sums.

Components become integers, so scores are exact. Lengths give the first bound: no score exceeds the product of
both lengths, so a query that has ``k`` scores above its length times the next vector's is done, and with it all
shorter vectors. A rotation by the singular vectors of a sample moves most of the length into the first places; after
some places the rest of the product is at most the product of both remaining lengths (Cauchy-Schwarz), and
pairs whose bound is below the query's k-th score so far are left. The remaining pairs are scored in whole
numbers. Any rotation gives the same result, so a bounded sample (``SAMPLE`` vectors) serves for it.

Queries are cut into blocks of about ``QUERIES``; ``GROUPS`` tasks a block see all vectors between them, each its
share by falling length, and keep ``k`` rows a query. So rows between stages are ``k * GROUPS`` a query, and vectors are
sent once a query block.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled with zeros;
empty ones score zero. Repeated rows and ids are vectors of their own; a query's own row is left out, an equal row isn't.
Equal scores go by id (null ids last; the greatest long counts as null). Lengths of integer vectors must be below 2**25. Other
columns are ignored; an empty table, or no query, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.llm.common import cut

SAMPLE, QUERIES, GROUPS, BLOCK = 10_000, 2048, 16, 2048
MOST_PARTITIONS = 20_000
NO_ID, NO_SCORE, NO_KEY = np.iinfo(np.int64).max, -(1 << 62), -np.iinfo(np.int64).max


def integers(vec: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vec: Column) -> Column:
    real = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vec.isNotNull() & F.forall(vec, real)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: the right singular vectors of the sample, strongest first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of floats, filled with zeros."""
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


class Search:
    """Best ``k`` of a block of queries over vectors that come by falling length."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int):
        self.rids, self.ids, self.q, self.turn, self.k = rids, ids, q, turn, k
        self.steps = sorted({s for s in (q.shape[1] // 8, q.shape[1] // 4, q.shape[1] // 2) if s})
        self.rotated, self.rest = self._split(q)
        self.norm = np.sqrt((q * q).sum(1))
        self.score, self.vec, self.row = np.full((len(q), k), NO_SCORE), np.full((len(q), k), NO_ID), np.full((len(q), k), NO_ID)
        self.least, self.done, self.pairs = np.full(len(q), -np.inf), False, 0

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rotated vectors, and the lengths that are left after each step."""
        r = x @ self.turn
        return r, [np.sqrt((r[:, s:] * r[:, s:]).sum(1)) for s in self.steps]

    def add(self, rids: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(v), BLOCK):
            if not self.done:
                self._block(*(x[lo : lo + BLOCK] for x in (rids, ids, v)))

    def _block(self, rids: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        norm = np.sqrt((v * v).sum(1))
        if self.norm.max() >= 1 << 25 or norm[0] >= 1 << 25:
            raise ValueError("vectors are too long for exact scores")
        slack = 1.0 + 1e-9 * self.norm * norm[0]  # for rounding; scores are whole numbers
        rows, cols = np.flatnonzero(self.norm * norm[0] + slack >= self.least), np.arange(len(v))
        if not len(rows):
            self.done = True
            return
        rotated, rest = self._split(v)
        total, last = np.zeros((len(rows), len(cols))), 0
        for s, left, right in zip(self.steps, self.rest, rest):
            total += self.rotated[rows, last:s] @ rotated[cols, last:s].T
            alive = total + left[rows, None] * right[cols] >= (self.least - slack)[rows, None]
            keep_r, keep_c, last = alive.any(1), alive.any(0), s
            if not keep_r.any():
                return
            if keep_r.mean() * keep_c.mean() < 0.9:
                total, rows, cols = total[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
        self.pairs += len(rows) * len(cols)
        exact = np.rint(self.q[rows] @ v[cols].T).astype(np.int64)
        place = np.empty(len(cols), np.int64)
        place[np.lexsort((rids[cols], ids[cols]))] = np.arange(len(cols))  # ties
        key = exact * BLOCK + (BLOCK - 1 - place)
        key[self.rids[rows, None] == rids[cols]] = NO_KEY
        best = np.argpartition(-key, self.k - 1, axis=1)[:, : self.k] if len(cols) > self.k else np.broadcast_to(np.arange(len(cols)), key.shape)
        own = np.take_along_axis(key, best, 1) == NO_KEY
        score = np.where(own, NO_SCORE, np.take_along_axis(exact, best, 1))
        merge = (np.hstack([self.score[rows], score]), np.hstack([self.vec[rows], np.where(own, NO_ID, ids[cols][best])]), np.hstack([self.row[rows], np.where(own, NO_ID, rids[cols][best])]))
        order = np.lexsort((merge[2], merge[1], -merge[0]), axis=1)[:, : self.k]
        for mine, new in zip((self.score, self.vec, self.row), merge):
            mine[rows] = np.take_along_axis(new, order, 1)
        kth = self.score[rows, -1]
        self.least[rows] = np.where(kth == NO_SCORE, -np.inf, kth)

    def result(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score != NO_SCORE)
        none = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(self.rids[q]), none(self.ids[q]), none(self.vec[q, j]), pa.array(self.row[q, j]), pa.array(self.score[q, j])], ["query_row", "query_id", "vec_id", "vec_row", "score"])


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, queries: int = QUERIES, groups: int = GROUPS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row of ``vectors(vec_id, embedding)`` the ``k`` other rows of highest inner product."""
    shape = "query_row long, query_id long, vec_id long, vec_row long, score long"
    own = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("e"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("e")))
    own = own.select("id", "asks", integers(F.col("e"), scale).alias("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    own = cut(own.withColumn("rid", F.monotonically_increasing_id()))
    width, asked = own.agg(F.max(F.size("v")), F.count_if("asks")).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    sample = own.select("v").orderBy(F.xxhash64("rid")).limit(SAMPLE).toArrow()["v"].combine_chunks()
    turn = rotation(_matrix(sample, width))  # width by width
    blocks = -(-asked // queries)
    hashed = lambda seed, n: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n)).cast("int")
    ask = own.where("asks").select(hashed(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), "norm", "rid", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "v")
    give = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), hashed(2, groups).alias("part"), F.lit(1).alias("kind"), "norm", "rid", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "v")
    dealt = ask.unionByName(give).repartition(min(blocks * groups, MOST_PARTITIONS), "block", "part").sortWithinPartitions("block", "part", "kind", F.desc("norm"), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, search = None, [], None
        for b in batches:
            key = np.column_stack([b.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                rids, ids = (b.column(c).slice(lo, hi - lo).to_numpy() for c in (4, 5))
                if group != tuple(key[lo, :2]):
                    if search is not None:
                        yield search.result()
                    group, waiting, search = tuple(key[lo, :2]), [], None
                part = (rids, ids, _matrix(b.column(6).slice(lo, hi - lo), width))
                if key[lo, 2] == 0:
                    waiting.append(part)
                    continue
                if search is None and waiting:
                    search = Search(*(np.concatenate(x) for x in zip(*waiting)), turn, k)
                if search is not None:
                    search.add(*part)
        if search is not None:
            yield search.result()

    found = dealt.mapInArrow(run, shape)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")  # ``k`` rows a group
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
