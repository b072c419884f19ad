"""Comparisons and summaries of result sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Full outer join on ``key``; other columns get a suffix."""
    name = lambda df, s: df.select(key, *[F.col(c).alias(c + s) for c in df.columns if c != key])
    return name(a, suffixes[0]).join(name(b, suffixes[1]), key, "full_outer")


def venn(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(only_a, both, only_b)`` counts of distinct keys, in one pass."""
    tagged = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))


TINY = 1e-9  # mass differences up to this size are one place of the axis


def _cells(mass: Column, tolerance: float, unit: str) -> Column:
    """Cells of the mass axis: a match takes others from its own cell and the two beside it only."""
    if unit == "Da":
        return F.floor(mass / (max(tolerance, TINY) * (1 + 1e-9)))
    if tolerance >= 5e5:
        raise ValueError("a relative tolerance must be below one half")
    size = F.greatest(F.abs(mass), F.lit(TINY))
    return F.when(mass < -TINY, -1).when(mass.isNotNull(), 1) * (F.floor(F.log(size / TINY) / -math.log1p(-tolerance * 1e-6) / 1.001) + 1)


def resolve(mass: np.ndarray, order: np.ndarray, tolerance: float, unit: str) -> np.ndarray:
    """The leader's place for each match; ``order`` has the places from best to worst.

    On sorted masses a leader takes an interval, less what is taken: every place is taken once, over links to the next one that's free.
    """
    rank = np.argsort(mass, kind="stable")
    sorted_mass, at = mass[rank], np.empty(len(mass), np.int64)
    at[rank] = np.arange(len(mass))
    free, leader = np.arange(len(mass) + 1), np.full(len(mass), -1)

    def next_free(k: int) -> int:
        while free[k] != k:
            free[k] = free[free[k]]
            k = free[k]
        return k

    for top in order.tolist():
        if leader[top] >= 0:
            continue
        by = 1.0 if unit == "Da" else max(abs(mass[top]), 1e-12) * 1e-6
        margin = tolerance * by * (1 + 1e-9) + 1e-12
        k = next_free(int(np.searchsorted(sorted_mass, mass[top] - margin, "left")))
        end = int(np.searchsorted(sorted_mass, mass[top] + margin, "right"))
        while k < end:
            if abs(sorted_mass[k] - mass[top]) / by <= tolerance:
                leader[rank[k]] = top
                free[k] = k + 1
            k = next_free(k + 1)
    return leader


def greedy_groups(df: DataFrame, tolerance: float, unit: str = "Da", by: str = "part") -> DataFrame:
    """``df(id, mass_diff, score, part)`` with ``leader``: the best match left takes all within the tolerance, and so on.

    The mass axis of a part is cut where cells of the tolerance's width stay empty; no leader reaches over such a gap, so the runs
    between gaps are resolved apart from each other. Equal scores go by id. Matches without a mass have no leader.
    """
    placed = df.withColumn("_cell", _cells(F.col("mass_diff").cast("double"), tolerance, unit))
    known = placed.where("_cell is not null")
    used = known.select(by, "_cell").distinct()
    before = F.lag("_cell").over(Window.partitionBy(by).orderBy("_cell"))  # a row a cell in use
    starts = used.withColumn("_new", F.coalesce(F.col("_cell") - before > 1, F.lit(True)).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(Window.partitionBy(by).orderBy("_cell"))).select(F.col(by).alias("_by"), F.col("_cell").alias("_c"), "_run")
    joined = known.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c"))).select(*df.columns, "_run")

    def solved(pdf: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        """Runs between ``edges``, each from best to worst."""
        mass, ids, out = pdf["mass_diff"].to_numpy(np.float64), pdf["id"].to_numpy(), []
        for a, b in zip(edges, edges[1:]):
            out.append(ids[a:b][resolve(mass[a:b], np.arange(b - a), tolerance, unit)])
        return pdf.iloc[: edges[-1]].drop(columns="_run").assign(leader=np.concatenate(out) if out else ids[:0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the run that may go on in the next batch
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            part, last = pdf[by], pdf[by].shift()
            new = (pdf["_run"] != pdf["_run"].shift()) | ((part != last) & ~(part.isna() & last.isna()))
            edges = np.flatnonzero(new.to_numpy()).tolist()
            yield solved(pdf, edges)
            kept = pdf.iloc[edges[-1] :].reset_index(drop=True)
        if kept is not None:
            yield solved(kept, [0, len(kept)])

    kind = dict(df.dtypes)["id"]
    ordered = joined.repartition(by, "_run").sortWithinPartitions(by, "_run", F.desc("score"), "id")
    done = ordered.mapInPandas(run, df.schema.simpleString()[7:-1] + f",leader:{kind}")
    return done.unionByName(placed.where("_cell is null").select(*df.columns, F.lit(None).cast(kind).alias("leader")))


def pareto(df: DataFrame, time: str, value: str, group: str) -> DataFrame:
    """Rows of each group with a higher value than all faster ones."""
    before = Window.partitionBy(group).orderBy(time, F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(value).over(before)).where(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def pareto_with_gap(df: DataFrame, time: str, value: str, group: str, gap: float = 0.1) -> DataFrame:
    """The same, and more than ``gap`` slower than the last kept: a fold over each group's frontier."""
    front = pareto(df, time, value, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")))).alias("rows"))
    none = F.array().cast("array<struct<t:double,v:double>>")
    last = lambda acc: F.element_at(acc, -1)
    keep = lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).when((r["v"] > last(acc)["v"]) & (r["t"] - last(acc)["t"] > gap), F.concat(acc, F.array(r))).otherwise(acc)
    return front.select(group, F.explode(F.aggregate("rows", none, keep)).alias("r")).select(group, F.col("r.t").alias(time), F.col("r.v").alias(value))


def blank_repeats(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Each column's value only on the first row, by ``order``, that has it."""
    return df.select(*[F.when(F.row_number().over(Window.partitionBy(c).orderBy(*order)) == 1, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def rank_cdf(ranks: DataFrame, rank: str, limits: list[int]) -> DataFrame:
    """``(k, share)``: the share of ranks up to each limit, in one pass."""
    one = ranks.agg(F.count("*").alias("n"), *[F.count_if(F.col(rank) <= k).alias(f"k{k}") for k in limits])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.col("n")).alias("share")) for k in limits])
    return one.select(F.explode(pairs).alias("p")).select("p.k", "p.share")


def rank_bins(ranks: DataFrame, rank: str, bins: int = 99) -> DataFrame:
    """``(bin, low, high, n, share)``: cumulative shares of ranks in bins of equal width in the logarithm, from the least to the greatest rank.

    Bins count from 0; the last one holds its upper edge.
    """
    ends = ranks.agg(F.min(rank).cast("double").alias("a"), F.max(rank).cast("double").alias("b"), F.count(rank).alias("all"))
    width = F.greatest((F.log10("b") - F.log10("a")) / bins, F.lit(1e-300))
    place = F.least(F.floor((F.log10(F.col(rank).cast("double")) - F.log10("a")) / width), F.lit(bins - 1)).cast("int")
    counts = ranks.where(F.col(rank).isNotNull()).join(F.broadcast(ends)).select(place.alias("bin"), "a", "b", "all").groupBy("bin", "a", "b", "all").agg(F.count("*").alias("n"))  # one row
    to_here = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    edge = lambda k: F.pow(F.lit(10.0), F.log10("a") + (F.log10("b") - F.log10("a")) / bins * k)
    return counts.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n", (F.sum("n").over(to_here) / F.col("all")).alias("share"))


def rank_thresholds(ranks: DataFrame, rank: str, shares: list[float]) -> DataFrame:
    """``(share, k)``: the smallest rank that covers each share of the rows. Ranks are counted first, so few rows are ordered."""
    counts = ranks.where(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("k")).agg(F.count("*").alias("n"))
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row a distinct rank
    covered = counts.withColumn("c", F.sum("n").over(run))
    total = ranks.agg(F.count(rank).alias("all"))
    wide = covered.join(F.broadcast(total)).agg(*[F.min(F.when(F.col("c") >= F.col("all") * s, F.col("k"))).alias(f"k{i}") for i, s in enumerate(shares)])  # one row
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"k{i}").cast("long").alias("k")) for i, s in enumerate(shares)])
    return wide.select(F.explode(pairs).alias("p")).select("p.share", "p.k")


def mass_group_stats(df: DataFrame, group: str, difference: str) -> DataFrame:
    return df.groupBy(group).agg(F.percentile(difference, F.lit(0.5)).alias("median_diff"), F.avg(difference).alias("mean_diff"), F.count("*").alias("n"))


def absolute_deviation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Median absolute difference of two scores for each setting."""
    return df.groupBy(*keys).agg(F.percentile(F.abs(F.col(a) - F.col(b)), F.lit(0.5)).alias("mad"))
