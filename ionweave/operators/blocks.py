"""Queries meet rows of the same key in blocks: the queries of a key stay in a task, the rows stream past in batches.

Each side is sent once a key, whatever the number of pairs; pairs exist only as matrices of one batch inside a task, and
a task gives what its kernel keeps (``k`` rows a query, say). Callers bound the queries of a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, PARTS, BATCH = 2048, 16, 1024
MOST_PARTITIONS = 20_000


class Kernel:
    """What is done with the queries of one key and the rows that meet them."""

    def __init__(self, queries: pa.Table):
        self.queries = queries

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch] | None:
        """Takes in rows; may give results at once."""
        raise NotImplementedError

    def result(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def meet(queries: DataFrame, rows: DataFrame, keys: Sequence[str], make, schema: str, partitions: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The results of ``make(queries).add(rows)`` for each key that has both; rows of a key come by rising ``order`` and ``id``."""
    both = queries.withColumn("_kind", F.lit(0)).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (*keys, "_kind", "id")]
    dealt = both.select(*keys, "_kind", "id", *others)
    dealt = dealt.repartition(min(partitions, MOST_PARTITIONS), *keys) if partitions else dealt.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, "_kind", *order, "id")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, kernel = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                key = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(width + 1)])
                edges = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
                for lo, hi in zip(edges, edges[1:]):
                    if group != tuple(key[lo, :width]):
                        if kernel is not None:
                            yield from kernel.result()
                        group, waiting, kernel = tuple(key[lo, :width]), [], None
                    part = b.slice(lo, hi - lo)
                    if key[lo, width] == 0:
                        waiting.append(part)
                    elif waiting:
                        kernel = kernel or make(pa.Table.from_batches(waiting))
                        yield from kernel.add(part) or ()
        if kernel is not None:
            yield from kernel.result()

    return dealt.mapInArrow(run, schema)


def dealt(queries: DataFrame, rows: DataFrame, asked: int, parts: int = PARTS) -> tuple[DataFrame, DataFrame, int]:
    """(queries, rows, keys) with ``block`` and ``part`` so that each of ``asked`` queries meets each row once."""
    blocks = max(1, -(-asked // QUERIES))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return queries.withColumn("block", place(blocks)).withColumn("part", each(parts)), rows.withColumn("part", place(parts)).withColumn("block", each(blocks)), blocks * parts


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exponents(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.sqrt((v * v).sum(1)))[1]


def products(q: np.ndarray, v: np.ndarray, q_exp: np.ndarray, v_exp: np.ndarray) -> np.ndarray:
    """Inner products to 42 bits of the product of both lengths, so that equal vectors tie wherever they are computed."""
    unit = np.ldexp(1.0, q_exp[:, None] + v_exp[None, :] - 42)
    return np.rint(q @ v.T / unit) * unit


class TopK(Kernel):
    """The ``k`` rows of highest inner product of each query; equal ones by rising id. Both sides have ``id, vec``."""

    k = 10

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        self.q = matrix(queries["vec"])
        self.exp = exponents(self.q)
        self.row, self.score, self.seq = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least, self.seen, self.names = np.full(len(self.q), -np.inf), 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        v = matrix(rows.column("vec"))
        s = products(self.q, v, self.exp, exponents(v))
        i, j = np.nonzero(s > self.least[:, None])  # an equal one comes later, so it has a greater id
        if len(i):
            row, score, seq = np.concatenate([self.row, i]), np.concatenate([self.score, s[i, j]]), np.concatenate([self.seq, self.seen + j])
            order = np.lexsort((seq, -score, row))
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = order[rank < self.k]
            self._name(rows.column("id"), seq[kept])
            self.row, self.score, self.seq = row[rank < self.k], score[kept], seq[kept]
            full = np.flatnonzero(rank == self.k - 1)
            self.least[row[full]] = score[order[full]]
        self.seen += len(v)

    def _name(self, ids: pa.Array, seq: np.ndarray) -> None:
        """Keeps the ids of the rows that are still among the best."""
        known, places = (self.names[0], self.names[1]) if self.names else (np.empty(0, np.int64), ids.slice(0, 0))
        pool = np.concatenate([known, self.seen + np.arange(len(ids))])
        kept = np.unique(seq)
        values = pa.concat_arrays([places, ids]).take(pa.array(np.searchsorted(pool, kept)))
        self.names = (kept, values)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.names:
            who = self.queries["id"].combine_chunks().take(pa.array(self.row))
            yield pa.RecordBatch.from_arrays([who, self.names[1].take(pa.array(np.searchsorted(self.names[0], self.seq))), pa.array(self.score)], ["query_id", "library_id", "score"])


def top_k(k: int):
    return type("TopK", (TopK,), {"k": k})


class BestOther(Kernel):
    """The best row of another ``label`` than the query's: ``(query_id, score, library_id)``."""

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        self.q, self.label = matrix(queries["vec"]), queries["label"].to_numpy()
        self.exp, self.score, self.best = exponents(self.q), np.full(len(self.q), -np.inf), [None] * len(self.q)

    def add(self, rows: pa.RecordBatch) -> None:
        v = matrix(rows.column("vec"))
        s = products(self.q, v, self.exp, exponents(v))
        s[self.label[:, None] == rows.column("label").to_numpy(zero_copy_only=False)[None, :]] = -np.inf
        j = s.argmax(1)  # the first: the smallest id
        top = s[np.arange(len(s)), j]
        for i in np.flatnonzero(top > self.score).tolist():
            self.score[i], self.best[i] = top[i], rows.column("id")[int(j[i])].as_py()

    def result(self) -> Iterator[pa.RecordBatch]:
        got = np.flatnonzero(self.score > -np.inf)
        ids = self.queries["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(got)), pa.array(self.score[got]), pa.array([self.best[i] for i in got.tolist()], ids.type)], ["query_id", "score", "library_id"])


class Above(Kernel):
    """How many rows come before a given one (``goal_score``, ``goal_id``) of each query: ``(query_id, n)``."""

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        self.q, self.score, self.goal = matrix(queries["vec"]), queries["goal_score"].to_numpy(), queries["goal_id"].to_numpy()
        self.exp, self.n = exponents(self.q), np.zeros(len(self.q), np.int64)

    def add(self, rows: pa.RecordBatch) -> None:
        v = matrix(rows.column("vec"))
        s = products(self.q, v, self.exp, exponents(v))
        self.n += (s > self.score[:, None]).sum(1)
        same, ids = s == self.score[:, None], rows.column("id").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(same.any(1)).tolist():
            self.n[i] += np.count_nonzero(same[i, : np.searchsorted(ids, self.goal[i])])  # rows come by id

    def result(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([self.queries["id"].combine_chunks(), pa.array(self.n)], ["query_id", "n"])
