"""Helpers shared by the corpus operators: checkpoints, tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder themselves (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/ionweave"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a local one for tests."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or LOCAL_CHECKPOINTS)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lost executors lose nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows and, unless one row alone is longer, ``size`` bytes in column ``at``."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
        lo, held = 0, 0
        for k, n in enumerate(lengths):
            if k > lo and (held + n > size or k - lo == rows):
                yield b.slice(lo, k - lo)
                lo, held = k, 0
            held += n
        yield b.slice(lo)


def crc_mod(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def root_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the undirected ``edges(a, b)``; the component is its smallest node.

    Min-label propagation with pointer jumping. Each round joins on single keys, keeps one row a
    node and one an edge, and is cut off by a checkpoint; a star of any size is one aggregation.
    """
    both = cut(edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n2")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, labels.node == seen.n2).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        nxt = cut(lower.join(jump, lower.component == jump.via, "left").select("node", "old", F.least("component", "further").alias("component")))
        labels = nxt.select("node", "component")
        if nxt.where("old != component").limit(1).count() == 0:
            return labels
