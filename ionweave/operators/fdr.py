"""False discovery rates by target-decoy competition, and groups of precursor mass differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def q_values(ssms: DataFrame, score: str = "score", decoy: str = "is_decoy", groups: Sequence[str] = ()) -> DataFrame:
    """``ssms`` with ``q``: the least (decoys + 1) / targets over all thresholds that let the match in; null for decoys.

    Counts are taken per distinct score first. Within a group, scores are cut into ranges whose totals are
    added up on few rows, so that no task orders a whole group of matches.
    """
    keys = list(groups)
    level = ssms.groupBy(*keys, score).agg(F.count(F.when(F.col(decoy), 1)).alias("d"), F.count(F.when(~F.col(decoy), 1)).alias("t"))
    n = min(LOTS, max(1, int(ssms.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    marks = ssms.agg(F.percentile_approx(score, [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []  # ``n`` scores
    ranged = level.withColumn("lot", marks_above(F.col(score), sorted(set(marks))))
    from_top = Window.partitionBy(*keys, "lot").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    lots = ranged.groupBy(*keys, "lot").agg(F.sum("d").alias("ld"), F.sum("t").alias("lt"), F.max(score).alias("top"))
    before = Window.partitionBy(*keys).orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    lots = lots.select(*keys, "lot", F.coalesce(F.sum("ld").over(before), F.lit(0)).alias("bd"), F.coalesce(F.sum("lt").over(before), F.lit(0)).alias("bt"))
    counted = _null_safe(ranged, lots, [*keys, "lot"])
    d, t = F.sum("d").over(from_top) + F.col("bd"), F.sum("t").over(from_top) + F.col("bt")
    fdr = counted.withColumn("fdr", F.when(t > 0, F.least((d + 1) / t, F.lit(1.0))).otherwise(F.lit(1.0)))
    least = fdr.groupBy(*keys, "lot").agg(F.min("fdr").alias("lf"), F.max(score).alias("top"))
    after = Window.partitionBy(*keys).orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, "lot", F.min("lf").over(after).alias("rest"))
    to_end = Window.partitionBy(*keys, "lot").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    q = _null_safe(fdr, least, [*keys, "lot"]).select(*keys, score, F.least(F.min("fdr").over(to_end), F.coalesce("rest", F.lit(1.0))).alias("q"))
    return _null_safe(ssms, q, [*keys, score]).withColumn("q", F.when(~F.col(decoy), F.col("q")))


LOTS = 256  # ranges of scores


def marks_above(value: Column, marks: list[float]) -> Column:
    """How many of the rising ``marks`` are greater, by a tree of comparisons as deep as their number has bits."""

    def down(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(len(marks) - lo)
        mid = (lo + hi) // 2
        return F.when(value >= marks[mid], down(mid + 1, hi)).otherwise(down(lo, mid))

    return down(0, len(marks))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, cond, "left").drop(*[f"_{k}" for k in keys])


def q_values_by_window(ssms: DataFrame, score: str = "score", decoy: str = "is_decoy", groups: Sequence[str] = ()) -> DataFrame:
    """The same by two windows a group; for groups that fit a task."""
    keys = list(groups) or [F.lit(0)]
    falling = Window.partitionBy(*keys).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    rising = Window.partitionBy(*keys).orderBy(score).rangeBetween(Window.unboundedPreceding, 0)
    d, t = F.count(F.when(F.col(decoy), 1)).over(falling), F.count(F.when(~F.col(decoy), 1)).over(falling)
    fdr = ssms.withColumn("_fdr", F.when(t > 0, F.least((d + 1) / t, F.lit(1.0))).otherwise(F.lit(1.0)))
    return fdr.withColumn("q", F.when(~F.col(decoy), F.min("_fdr").over(rising))).drop("_fdr")


def residual_groups(df: DataFrame, group: str, least: int, weight: str | None = None) -> DataFrame:
    """Groups of fewer than ``least`` rows (or a sum of ``weight`` below it) become group -1."""
    small = df.groupBy(group).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).where(F.col("_n") < least).select(F.col(group).alias("_g"))
    return df.join(small, F.col(group) == F.col("_g"), "left").withColumn(group, F.when(F.col("_g").isNotNull(), F.lit(-1)).otherwise(F.col(group))).drop("_g")


def mass_difference(exp_mz: Column, calc_mz: Column, charge: Column) -> Column:
    return (exp_mz - calc_mz) * charge


def shift_histogram(df: DataFrame, difference: str = "mass_diff", bins: int = 100, weight: str | None = None) -> DataFrame:
    """``(nominal, bin, n)``: counts (or sums of ``weight``) in ``bins`` bins over each nominal mass difference; empty bins are left out."""
    nominal = F.bround(difference).cast("int")
    place = F.least(F.floor((F.col(difference) - (nominal - 0.5)) * bins), F.lit(bins - 1)).cast("int")
    each = F.col(weight) if weight else F.lit(1)
    return df.select(nominal.alias("nominal"), place.alias("bin"), each.cast("long").alias("n")).groupBy("nominal", "bin").agg(F.sum("n").alias("n"))


def find_peaks(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, left base, right base) of each local maximum; plateaus count at their middle.

    A base is the lowest point between a peak and the next higher ground on that side, the nearest such.
    """
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                p = (i + j) // 2
                left, k = p, p
                while k >= 0 and x[k] <= x[p]:
                    left = k if x[k] < x[left] else left
                    k -= 1
                right, k = p, p
                while k < n and x[k] <= x[p]:
                    right = k if x[k] < x[right] else right
                    k += 1
                out.append((p, left, right))
            i = j
        i += 1
    return out


def shift_groups(df: DataFrame, difference: str = "mass_diff", least: int = 100, weight: str | None = None) -> DataFrame:
    """``df`` with ``mass_group``: matches at the same peak of the mass-difference histogram; -1 for the rest.

    A row stands for ``weight`` matches, if it is given. Histograms are counted in Spark. Their peaks (at most 100 bins a nominal mass) come from one small task
    for each nominal mass, and matches find their peak by a broadcast of those few rows.
    """
    hist = shift_histogram(df, difference, weight=weight)

    def peaks(key, pdf):
        counts = np.zeros(100, np.int64)
        counts[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        edges = np.linspace(key[0] - 0.5, key[0] + 0.5, 101)
        found = find_peaks(counts)
        return pd.DataFrame({"nominal": [key[0]] * len(found), "at": [edges[p] for p, _, _ in found], "low": [edges[a] for _, a, _ in found], "high": [edges[b] for _, _, b in found]})

    table = hist.groupBy("nominal").applyInPandas(peaks, "nominal int, at double, low double, high double")
    # nominal masses are bounded by the open window, so all peaks together are a small table
    numbered = table.withColumn("peak", F.row_number().over(Window.orderBy("nominal", "at")) - 1)
    near = numbered.groupBy("nominal").agg(F.array_sort(F.collect_list(F.struct("peak", "at", "low", "high"))).alias("near"))
    d = F.col(difference)
    choice = F.array_sort(F.transform(F.filter("near", lambda p: (p["low"] < d) & (d < p["high"])), lambda p: F.struct(F.abs(p["at"] - d).alias("far"), p["peak"].alias("peak"))))
    joined = df.withColumn("nominal", F.bround(difference).cast("int")).join(near, "nominal", "left")
    grouped = joined.withColumn("mass_group", F.coalesce(F.try_element_at(choice, F.lit(1))["peak"], F.lit(-1))).drop("nominal", "near")
    return residual_groups(grouped, "mass_group", least, weight)


def impute_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite values replaced by the column's greatest finite one."""
    bound = lambda c: F.abs(F.col(c)) < float("inf")
    top = df.agg(*[F.max(F.when(bound(c), F.col(c))).alias(f"_{c}") for c in columns])
    wide = df.join(F.broadcast(top))  # one row
    return wide.select(*[F.when(bound(c), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
