"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints within 2 bits either agree on one
segment (the other then differs in at most 2 bits) or differ in one bit of each. So each
fingerprint is filed under both whole segments and under the 32 members of the one-bit ball of
its high segment (the ball's two ends share the key with that bit cleared). Every bucket is
searched for complete distances: small buckets by neighbours in the sorted run, larger ones by
clearing one or two bits and sorting, which is linear in the bucket and emits a spanning star, never
all pairs. Buckets beyond ``hot`` members go the same way as Spark rows instead of in one task.

Nulls and empty texts have fingerprint zero and are linked like others; equal texts have equal
fingerprints; repeated rows and ids each give their row; whole texts are read, however long; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import connected_components, cut, root_labels

SEED = 42
LOW = np.uint64(0xFFFFFFFF)
PAIR_MASKS = [np.uint64((1 << i) | (1 << j)) for i, j in combinations(range(32), 2)]
ONE_MASKS = [np.uint64(1 << i) for i in range(32)]
SMALL = 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    flat, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h64(flat, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    h = np.array([h64(flat[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())], dtype=">u8")
    n, by = len(h), h.view(np.uint8).reshape(-1, 8)
    if n < 1500:
        votes = np.unpackbits(by, axis=1).sum(axis=0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every document; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", size) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bucket_links(case: np.ndarray, group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Root index of each row among its bucket's rows; ``group`` is sorted, ``fp`` unique in it."""
    left, right = [], []
    n, sizes = len(fp), np.bincount(group)[group]
    small = np.flatnonzero(sizes <= SMALL)
    for k in range(1, SMALL):
        a, b = small[:-k], small[k:]
        if not len(a):
            break
        same = group[a] == group[b]
        a, b = a[same], b[same]
        if not len(a):
            break
        near = np.bitwise_count(fp[a] ^ fp[b]) <= 2
        left.append(a[near])
        right.append(b[near])
    for pick, masks in ((case < 2, PAIR_MASKS), (case >= 2, ONE_MASKS)):
        rows = np.flatnonzero((sizes > SMALL) & pick)
        if not len(rows):
            continue
        value = np.where(case[rows] == 1, fp[rows] >> np.uint64(32), fp[rows] & LOW)
        base = group[rows].astype(np.uint64) << np.uint64(32)
        for m in masks:
            key = base | (value & ~m)
            order = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[order][1:] == key[order][:-1])
            left.append(rows[order[same + 1]])
            right.append(rows[order[same]])
    if not left:
        return np.arange(n)
    return root_labels(n, np.concatenate(left), np.concatenate(right))


def _search(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, bucket):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) for x in (a, b, bucket)], ["a", "b", "bucket"])

        def search(bucket, fp):
            if len(fp) < 2:
                return
            group = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
            many = np.bincount(group)[group] > 1
            if not many.any():
                return
            bucket, fp, group = bucket[many], fp[many], np.unique(group[many], return_inverse=True)[1]
            root = _bucket_links((bucket >> np.uint64(32)).astype(np.int64), group, fp)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            if len(moved):
                yield out(fp[root[moved]], fp[moved], np.full(len(moved), 2**64 - 1, np.uint64))

        bucket, fp, spilling = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for b in batches:
            bucket = np.concatenate([bucket, b.column(0).to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            if spilling is not None:
                own = bucket == spilling
                if own.any():
                    yield out(fp[own], fp[own], bucket[own])
                bucket, fp = bucket[~own], fp[~own]
                if not len(bucket):
                    continue
                spilling = None
            if not len(bucket):
                continue
            tail = np.searchsorted(bucket, bucket[-1])
            yield from search(bucket[:tail], fp[:tail])
            bucket, fp = bucket[tail:], fp[tail:]
            if len(bucket) > hot:
                spilling = bucket[-1]
                yield out(fp, fp, bucket)
                bucket, fp = bucket[:0], fp[:0]
        yield from search(bucket, fp)

    return run


def _hot_links(rows: DataFrame) -> DataFrame:
    """The same search for buckets too large for one task: a row for each cleared mask; at most four meet."""
    case = F.shiftrightunsigned("bucket", 32)
    low, high = F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("a", 32)
    value = F.when(case == 1, high).otherwise(low)
    masks = F.when(case < 2, F.array(*[F.lit(int(m)) for m in PAIR_MASKS])).otherwise(F.array(*[F.lit(int(m)) for m in ONE_MASKS]))
    keyed = rows.select("bucket", "a", value.alias("v"), F.explode(masks).alias("m")).select("bucket", "m", F.col("v").bitwiseAND(F.bitwise_not("m")).alias("k"), "a")
    met = keyed.groupBy("bucket", "m", "k").agg(F.collect_list("a").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a != b")


def links(fps: DataFrame, hot: int = 500_000) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``fp`` within 2 bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [high, low.bitwiseOR(F.lit(1 << 32))]
    keys += [high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))).bitwiseOR(F.lit((2 + j) << 32)) for j in range(32)]
    filed = fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = cut(filed.mapInArrow(_search(hot), "a long, b long, bucket long"))
    edges = found.where("bucket = -1").select("a", "b")
    if found.where("bucket != -1").limit(1).count():
        edges = edges.unionByName(_hot_links(found.where("bucket != -1")))
    return edges


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: fingerprints within 2 bits link, components are transitive."""
    own = cut(fingerprints(docs, size))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(links(distinct.select("fp")))
    named = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.join(lowest, "component").select(F.col("fp").alias("fp2"), "component_id")
    joined = own.join(ids, own.fp == ids.fp2)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
