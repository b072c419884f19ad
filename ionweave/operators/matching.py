"""Alignment of two peak lists and the best library match of each query, in column expressions.

Pairs of peaks within the fragment tolerance, optionally shifted by the precursor mass difference over
each charge, are taken greedily by falling product of intensities, each peak once. Equal products
go by query peak and then by library peak, so the result doesn't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ANNOTATION = 2.0 / 3.0  # weight of a shifted match whose peak has no charge annotation


def shifts(query_mz: Column, library_mz: Column, charge: Column, tolerance: float, allow_shift: bool) -> Column:
    """Mass shifts tried: none, and the precursor difference over 1 to ``charge`` where it is large enough."""
    none = F.array(F.lit(0.0))
    if not allow_shift:
        return none
    delta = (query_mz - library_mz) * charge
    return F.when(F.abs(delta) >= tolerance, F.concat(none, F.transform(F.sequence(F.lit(1), charge), lambda k: delta / k))).otherwise(none)


def peak_pairs(q: Column, lib: Column, moves: Column, tolerance: float, annotated: bool = False) -> Column:
    """All matching ``(q, l, w)`` of two peak lists: 0-based places and weights."""

    def weight(p, r, s):
        product = p["intensity"] * r["intensity"]
        if not annotated:
            return F.when(s == 0, product).otherwise(product * NO_ANNOTATION)
        charge = F.coalesce(r["ion_charge"], F.lit(0))
        return F.when(s == 0, product).when(charge == s, product).when(charge == 0, product * NO_ANNOTATION)

    def of(p, i):
        def shifted(d, s):
            hit = F.transform(lib, lambda r, j: F.struct(i.alias("q"), j.alias("l"), F.when(F.abs(p["mz"] - (r["mz"] + d)) <= tolerance, weight(p, r, s)).alias("w")))
            return F.filter(hit, lambda m: m["w"].isNotNull())

        return F.flatten(F.transform(moves, shifted))

    return F.flatten(F.transform(q, of))


def greedy(pairs: Column) -> Column:
    """One-to-one assignment from ``pairs``, strongest first."""
    key = F.array_sort(F.transform(pairs, lambda m: F.struct((-m["w"]).alias("o"), m["q"].alias("q"), m["l"].alias("l"))))
    free = lambda acc, m: ~F.exists(acc, lambda t: (t["q"] == m["q"]) | (t["l"] == m["l"]))
    none = F.array().cast("array<struct<o:double,q:int,l:int>>")
    taken = F.aggregate(key, none, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    return F.transform(taken, lambda m: F.struct(m["q"].alias("q"), m["l"].alias("l"), (-m["o"]).alias("w")))


def score_of(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["w"])


def with_spectra(pairs: DataFrame, queries: DataFrame, library: DataFrame) -> DataFrame:
    """Candidate pairs with both spectra, joined late by id."""
    side = lambda df, key, p: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("precursor_mz", "peaks")], *([F.col("is_decoy"), F.col("peptide")] if p == "l" else []), *([F.col("precursor_charge").alias("charge")] if p == "q" else []))
    return pairs.join(side(queries, "query_id", "q"), ["query_id", "charge"]).join(side(library, "library_id", "l"), "library_id")


def match_arrays(qm, qi, lm, li, charges, moves, tolerance: float, annotated: bool) -> list[tuple[int, int, float]]:
    """The greedy assignment of one pair, from arrays of m/z, intensities, annotated charges and shifts."""
    near = np.abs(qm[None, :, None] - (lm[None, None, :] + moves[:, None, None])) <= tolerance
    s, q, j = np.nonzero(near)
    w = qi[q] * li[j]
    moved = moves[s] != 0
    if annotated:
        loose = moved & (charges[j] == 0)
        keep = ~moved | (charges[j] == s) | loose
        w = np.where(loose, w * NO_ANNOTATION, w)
        q, j, w = q[keep], j[keep], w[keep]
    else:
        w = np.where(moved, w * NO_ANNOTATION, w)
    used_q, used_l, out = set(), set(), []
    for k in np.lexsort((j, q, -w)).tolist():
        a, b = int(q[k]), int(j[k])
        if a not in used_q and b not in used_l:
            used_q.add(a)
            used_l.add(b)
            out.append((a, b, float(w[k])))
    return out


def _matcher(tolerance: float, annotated: bool):
    @F.pandas_udf("array<struct<q:int,l:int,w:double>>")
    def matcher(qm: pd.Series, qi: pd.Series, lm: pd.Series, li: pd.Series, charges: pd.Series, moves: pd.Series) -> pd.Series:
        return pd.Series([[{"q": q, "l": j, "w": w} for q, j, w in match_arrays(*row, tolerance, annotated)] for row in zip(qm, qi, lm, li, charges, moves)])

    return matcher


def align(pairs: DataFrame, tolerance: float, allow_shift: bool, annotated: bool = False, native: bool = True) -> DataFrame:
    """``pairs`` with ``matches`` and their ``dot`` score.

    Array functions visit every pair of peaks, shift by shift, in interpreted lambdas; ``native=False`` does the same
    on whole arrays in a Pandas UDF, which is some ten times faster where windows are wide.
    """
    moves = shifts(F.col("q_precursor_mz"), F.col("l_precursor_mz"), F.col("charge"), tolerance, allow_shift)
    if native:
        matched = pairs.withColumn("moves", moves).withColumn("matches", greedy(peak_pairs(F.col("q_peaks"), F.col("l_peaks"), F.col("moves"), tolerance, annotated)))
        return matched.drop("moves").withColumn("dot", score_of(F.col("matches")))
    part = lambda c, n, kind="double": F.transform(c, lambda p: F.coalesce(p[n], F.lit(0)).cast(kind))
    charge = part("l_peaks", "ion_charge", "int") if annotated else F.array().cast("array<int>")
    found = _matcher(tolerance, annotated)(part("q_peaks", "mz"), part("q_peaks", "intensity"), part("l_peaks", "mz"), part("l_peaks", "intensity"), charge, moves)
    return pairs.withColumn("matches", found).withColumn("dot", score_of(F.col("matches")))


def best_match(aligned: DataFrame) -> DataFrame:
    """``(query_id, library_id, charge, matches, dot, num_candidates)``: the best candidate of each query, also over charges.

    Equal scores go to the smaller library id. One aggregation that combines before its shuffle and carries ids and matches
    only; ``with_spectra`` attaches the winners' peaks.
    """
    rank = F.struct((-F.col("dot")).alias("o"), "library_id", "charge")
    chosen = aligned.groupBy("query_id").agg(F.min_by(F.struct("library_id", "charge", "matches", "dot"), rank).alias("m"), F.count("*").alias("num_candidates"))
    return chosen.select("query_id", "m.*", "num_candidates")


def annotated_pairs(ssms: DataFrame) -> DataFrame:
    """Both peak lists of each match, a row a peak, with the library's annotation on matched query peaks."""
    side = lambda s, other: ssms.select("query_id", "library_id", F.lit(s).alias("side"), F.posexplode(f"{s}_peaks").alias("i", "p"), "matches", "l_peaks").select("query_id", "library_id", "side", "i", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), F.expr(f"try_element_at(transform(filter(matches, m -> m.{s} = i), m -> m.{other}), 1)").alias("partner"), "l_peaks")
    both = side("q", "l").unionByName(side("l", "q"))
    label = lambda p: F.concat(p["ion_type"], p["ion_index"].cast("string"))
    own = F.when(F.col("side") == "l", F.get("l_peaks", F.col("i"))).otherwise(F.get("l_peaks", F.col("partner")))
    return both.withColumn("ion", F.when(F.col("partner").isNotNull(), F.coalesce(label(own), F.lit("unknown")))).drop("l_peaks")
