"""Similarity of two aligned peak lists, as column expressions on one row: nothing is shuffled.

``Aligned`` holds the arrays that the measures need. With ``top`` set, only the matches of the ``top``
strongest library peaks count, and unmatched library peaks are those of them without a match; the
measures that are not defined for it raise ``NotImplementedError``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ionweave.operators.preprocess import by_intensity, field, let, total
from ionweave.operators.vectorize import dimensions

INF = float("inf")


class Aligned:
    """Arrays of matched (Q, L) and unmatched (uQ, uL) intensities of a pair."""

    def __init__(self, q: Column, lib: Column, matches: Column, top: int | None = None):
        self.top, self.q, self.l = top, q, lib
        used = matches
        if top is not None:
            strongest = F.slice(by_intensity(F.transform(lib, lambda p, i: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), i.alias("i")))), 1, top)
            place = F.transform(strongest, lambda p: p["i"])
            used = F.filter(matches, lambda m: F.array_contains(place, m["l"]))
        at_q, at_l = F.transform(matches, lambda m: m["q"]), F.transform(used, lambda m: m["l"])
        pick = lambda peaks, end, name: F.transform(used, lambda m: F.get(peaks, m[end])[name].cast("double"))
        self.Q, self.L = pick(q, "q", "intensity"), pick(lib, "l", "intensity")
        self.mQ, self.mL = pick(q, "q", "mz"), pick(lib, "l", "mz")
        rest = lambda peaks, at: F.transform(F.filter(peaks, lambda p, i: ~F.array_contains(at, i)), lambda p: p["intensity"].cast("double"))
        self.uQ = rest(q, at_q)
        self.uL = rest(lib, at_l) if top is None else F.transform(F.filter(strongest, lambda p: ~F.array_contains(at_l, p["i"])), lambda p: p["intensity"].cast("double"))
        self.iq, self.il = field(q, "intensity"), field(lib, "intensity")
        self.none = F.size(used) == 0

    @classmethod
    def on(cls, df: DataFrame, q: str, lib: str, matches: str, top: int | None = None) -> tuple[DataFrame, Aligned]:
        """``df`` with the arrays as columns (dropped again by ``off``), and the aligned pair that reads them."""
        s = cls(F.col(q), F.col(lib), F.col(matches), top)
        names = ("Q", "L", "mQ", "mL", "uQ", "uL", "iq", "il", "none")
        df = df.withColumns({f"_aligned{top or ''}_{n}": getattr(s, n) for n in names})
        for n in names:
            setattr(s, n, F.col(f"_aligned{top or ''}_{n}"))
        return df, s

    @staticmethod
    def off(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith("_aligned")])

    def or_else(self, value: Column, empty: float) -> Column:
        return F.when(self.none, F.lit(empty)).otherwise(value)

    def whole_only(self, name: str) -> None:
        if self.top is not None:
            raise NotImplementedError(f"{name} is not defined for the strongest peaks only")


def zipped(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


def summed(a: Column, f=lambda v: v) -> Column:
    return total(F.transform(a, f))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b``; ``empty`` where ``b`` is 0 (intensities that are all 0)."""
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def _norm(a: Column) -> Column:
    return F.sqrt(summed(a, lambda v: v * v))


def cosine(s: Aligned) -> Column:
    dot = zipped(s.Q, s.L, lambda a, b: a * b)
    return s.or_else(dot if s.top is None else ratio(dot, _norm(s.Q) * _norm(s.L)), 0.0)


def n_matched_peaks(s: Aligned) -> Column:
    return F.size(s.Q).cast("double")


def frac_n_peaks_query(s: Aligned) -> Column:
    s.whole_only("frac_n_peaks_query")
    return s.or_else(F.size(s.Q) / F.size(s.q), 0.0)


def frac_n_peaks_library(s: Aligned) -> Column:
    return s.or_else(F.size(s.L) / (F.size(s.L) + F.size(s.uL)), 0.0)


def frac_intensity_query(s: Aligned) -> Column:
    s.whole_only("frac_intensity_query")
    return s.or_else(ratio(summed(s.Q), summed(s.iq)), 0.0)


def frac_intensity_library(s: Aligned) -> Column:
    return s.or_else(ratio(summed(s.L), summed(s.L) + summed(s.uL)), 0.0)


def mean_squared_error(s: Aligned, axis: str) -> Column:
    if axis not in ("mz", "intensity"):
        raise ValueError(f"unknown axis {axis!r}")
    a, b = (s.mQ, s.mL) if axis == "mz" else (s.Q, s.L)
    return s.or_else(zipped(a, b, lambda x, y: (x - y) * (x - y)) / F.size(s.Q), INF)


def spectral_contrast_angle(s: Aligned) -> Column:
    return 1 - 2 * F.acos(F.least(F.greatest(cosine(s), F.lit(0.0)), F.lit(1.0))) / math.pi


def ms_for_id_v1(s: Aligned) -> Column:
    nq, nl = (F.size(s.q), F.size(s.l)) if s.top is None else (F.lit(s.top), F.lit(s.top))
    gap = F.greatest(zipped(s.Q, s.L, lambda a, b: F.abs(a - b)), F.lit(2.220446049250313e-16))
    return s.or_else(F.least(F.pow(F.size(s.Q), F.lit(4)) / (nq * nl * F.pow(gap, F.lit(0.25))), F.lit(1000.0)), 0.0)


def ms_for_id_v2(s: Aligned) -> Column:
    s.whole_only("ms_for_id_v2")
    above = F.pow(F.size(s.Q), F.lit(4)) * F.pow(summed(s.iq) + 2 * summed(s.il), F.lit(1.25))
    below = F.pow(F.size(s.q) + 2 * F.size(s.l), F.lit(2)) + zipped(s.Q, s.L, lambda a, b: F.abs(a - b)) + zipped(s.mQ, s.mL, lambda a, b: F.abs(a - b))
    return s.or_else(above / below, 0.0)


def manhattan(s: Aligned) -> Column:
    s.whole_only("manhattan")
    return s.or_else(zipped(s.Q, s.L, lambda a, b: F.abs(a - b)) + summed(s.uQ) + summed(s.uL), INF)


def euclidean(s: Aligned) -> Column:
    s.whole_only("euclidean")
    square = lambda v: v * v
    return s.or_else(F.sqrt(zipped(s.Q, s.L, lambda a, b: (a - b) * (a - b)) + summed(s.uQ, square) + summed(s.uL, square)), INF)


def chebyshev(s: Aligned) -> Column:
    s.whole_only("chebyshev")
    return s.or_else(F.array_max(F.concat(F.zip_with(s.Q, s.L, lambda a, b: F.abs(a - b)), s.uQ, s.uL)), INF)


def _pearson(x: Column, y: Column) -> Column:
    mx, my = summed(x) / F.size(x), summed(y) / F.size(y)
    sxy = zipped(x, y, lambda a, b: (a - mx) * (b - my))
    r = F.try_divide(sxy, F.sqrt(summed(x, lambda v: (v - mx) * (v - mx)) * summed(y, lambda v: (v - my) * (v - my))))
    varies = (F.array_max(x) > F.array_min(x)) & (F.array_max(y) > F.array_min(y))  # sums of equal values may round to a spread that isn't there
    return F.when(varies, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def _ranks(a: Column) -> Column:
    """Average ranks."""
    below = lambda v: F.size(F.filter(a, lambda o: o < v))
    same = lambda v: F.size(F.filter(a, lambda o: o == v))
    return F.transform(a, lambda v: below(v) + (same(v) + 1) / 2.0)


def _padded(s: Aligned) -> tuple[Column, Column]:
    return F.concat(s.Q, F.transform(s.uL, lambda v: F.lit(0.0))), F.concat(s.L, s.uL)


def pearsonr(s: Aligned) -> Column:
    return s.or_else(_pearson(*_padded(s)), 0.0)


def spearmanr(s: Aligned) -> Column:
    x, y = _padded(s)
    return s.or_else(_pearson(_ranks(x), _ranks(y)), 0.0)


def braycurtis(s: Aligned) -> Column:
    s.whole_only("braycurtis")
    rest = summed(s.uQ) + summed(s.uL)
    return s.or_else(ratio(zipped(s.Q, s.L, lambda a, b: F.abs(a - b)) + rest, zipped(s.Q, s.L, lambda a, b: F.abs(a + b)) + rest, 1.0), 1.0)


def canberra(s: Aligned) -> Column:
    s.whole_only("canberra")
    some = lambda a: F.size(F.filter(a, lambda v: v != 0))
    return s.or_else(zipped(s.Q, s.L, lambda a, b: F.when(a + b == 0, F.lit(0.0)).otherwise(F.abs(a - b) / (a + b))) + some(s.uQ) + some(s.uL), INF)


def ruzicka(s: Aligned) -> Column:
    s.whole_only("ruzicka")
    return s.or_else(ratio(zipped(s.Q, s.L, lambda a, b: F.least(a, b)), zipped(s.Q, s.L, lambda a, b: F.greatest(a, b)) + summed(s.uQ) + summed(s.uL)), 0.0)


def scribe_fragment_acc(s: Aligned) -> Column:
    gap = zipped(s.Q, s.L, lambda a, b: (a - b) * (a - b)) + summed(s.uL, lambda v: v * v)
    return s.or_else(F.when(gap == 0, F.lit(10.0)).otherwise(F.log(1 / gap)), 0.0)


def _entropy(p: Column) -> Column:
    mass = summed(p)
    return -summed(p, lambda v: F.when(v > 0, v / mass * F.log(v / mass)).otherwise(F.lit(0.0)))


def entropy(s: Aligned, weighted: bool = False) -> Column:
    """One less the merged spectrum's excess entropy; weighting raises low-entropy intensities to a power first."""
    s.whole_only("entropy")

    def of(a: Column) -> Column:
        if not weighted:
            return _entropy(a)
        return let(_entropy(a), lambda h: F.when(h > 3, h).otherwise(_entropy(F.transform(a, lambda v: F.pow(v, 0.25 + 0.25 * h)))))

    merged = F.concat(F.zip_with(s.Q, s.L, lambda a, b: (a + b) / 2), F.transform(F.concat(s.uQ, s.uL), lambda v: v / 2))
    return s.or_else(1 - (2 * of(merged) - of(s.iq) - of(s.il)) / math.log(4), 0.0)


def hypergeometric_tail(matched: int, peaks: int, bins: int) -> float:
    """Minus the logarithm of the chance of more than ``matched`` matches, at most 100."""
    ways = sum(math.comb(peaks, i) * math.comb(bins - peaks, peaks - i) for i in range(matched + 1, peaks + 1))
    return min(100.0, math.log(math.comb(bins, peaks)) - math.log(ways)) if ways else 100.0


@lru_cache(maxsize=None)
def _permutations_by_inversions(n: int) -> np.ndarray:
    """How many orders of ``n`` values have 0, 1, 2, ... inversions, as shares of all orders (Mahonian numbers over n!)."""
    share = np.ones(1)
    for k in range(2, n + 1):  # the k-th value adds 0 to k - 1 inversions, each with a chance of 1/k
        share = np.convolve(share, np.full(k, 1 / k))
    return share


def kendall_p_value(x: list[float], y: list[float]) -> float | None:
    """Two-sided p-value of Kendall's tau-b; None if undefined.

    Without ties, for up to 33 values or at most one inversion either way, the exact distribution of
    inversions; else the normal limit with the variance of the score under ties (Kendall, Rank Correlation Methods).
    """
    a, b = np.asarray(x, float), np.asarray(y, float)
    n = len(a)
    if n < 2 or (a == a[0]).all() or (b == b[0]).all():
        return None
    score = float((np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() / 2)
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (a, b))
    pairs = n * (n - 1) / 2
    fewest = (pairs - abs(score)) / 2  # inversions, counted from the nearer end
    if t.max() == u.max() == 1 and (n <= 33 or fewest <= 1):
        if n > 33:
            return 2 * (1 if fewest == 0 else n) / math.factorial(n)
        return min(1.0, 2 * float(_permutations_by_inversions(n)[: int(fewest) + 1].sum())) if score else 1.0
    both = lambda f: (f(t).sum(), f(u).sum())
    wide = lambda v: v * (v - 1) * (2 * v + 5)
    (t5, u5), (t2, u2), (t3, u3) = both(wide), both(lambda v: v * (v - 1)), both(lambda v: v * (v - 1) * (v - 2))
    variance = (wide(float(n)) - t5 - u5) / 18 + t2 * u2 / (4 * pairs)
    if n > 2:
        variance += t3 * u3 / (18 * pairs * (n - 2))
    return math.erfc(abs(score) / math.sqrt(2 * variance)) if variance > 0 else None


def hypergeometric_score(s: Aligned, min_mz: float, max_mz: float, width: float) -> Column:
    """Vectorised in Python: the binomials need exact integers."""
    bins = dimensions(min_mz, max_mz, width)[0]

    @pandas_udf("double")
    def score(matched, peaks):
        import pandas as pd

        known: dict[tuple[int, int], float] = {}
        out = []
        for m, n in zip(matched.tolist(), peaks.tolist()):
            if (m, n) not in known:
                known[m, n] = hypergeometric_tail(m, n, bins)
            out.append(known[m, n])
        return pd.Series(out, dtype="float64")

    peaks = F.size(s.l) if s.top is None else F.when(s.none, F.lit(s.top)).otherwise(F.size(s.L) + F.size(s.uL))
    return score(F.size(s.L), peaks)


def kendalltau(s: Aligned) -> Column:
    """Vectorised in Python: the exact null distribution is a recurrence over big integers."""

    @pandas_udf("double")
    def score(q, lib):
        import pandas as pd

        p = [kendall_p_value([float(v) for v in a], [float(v) for v in b]) for a, b in zip(q, lib)]
        return pd.Series([0.0 if v is None else -math.log(v) if v > 0 else 1000.0 for v in p], dtype="float64")

    return score(s.Q, s.L)


def with_features(df: DataFrame, q: str, lib: str, matches: str, min_mz: float, max_mz: float, bin_size: float, top: int = 5) -> tuple[DataFrame, list[str]]:
    """``df`` with all similarity features, over all peaks and over the ``top`` strongest of the library, and their names."""
    df, a = Aligned.on(df, q, lib, matches)
    df, t = Aligned.on(df, q, lib, matches, top)
    out: dict[str, Column] = {}
    for name in ("cosine", "n_matched_peaks", "frac_n_peaks_library", "frac_intensity_library", "spectral_contrast_angle", "kendalltau", "ms_for_id_v1", "pearsonr", "spearmanr", "scribe_fragment_acc"):
        out[name], out[f"{name}_top"] = globals()[name](a), globals()[name](t)
    for axis in ("mz", "intensity"):
        out[f"mse_{axis}"], out[f"mse_{axis}_top"] = mean_squared_error(a, axis), mean_squared_error(t, axis)
    out["hypergeometric_score"], out["hypergeometric_score_top"] = hypergeometric_score(a, min_mz, max_mz, bin_size), hypergeometric_score(t, min_mz, max_mz, bin_size)
    for name in ("frac_n_peaks_query", "frac_intensity_query", "ms_for_id_v2", "manhattan", "euclidean", "chebyshev", "braycurtis", "canberra", "ruzicka"):
        out[name] = globals()[name](a)
    out["entropy_unweighted"], out["entropy_weighted"] = entropy(a), entropy(a, weighted=True)
    return Aligned.off(df.withColumns(out)), list(out)
