"""Cleaning and scaling of peak lists: column expressions over ``peaks``, no shuffle.

``peaks`` is an array of structs with at least ``mz`` and ``intensity``, sorted by m/z; other fields travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.config import SearchConfig


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def field(peaks: Column, name: str) -> Column:
    return F.transform(peaks, lambda p: p[name].cast("double"))


def with_intensity(peaks: Column, value) -> Column:
    """``peaks`` with each intensity replaced by ``value(peak)``."""
    return F.transform(peaks, lambda p: p.withField("intensity", value(p)))


def by_mz(peaks: Column) -> Column:
    return F.array_sort(peaks, lambda a, b: F.when(a["mz"] < b["mz"], -1).when(a["mz"] > b["mz"], 1).otherwise(F.when(a["intensity"] < b["intensity"], -1).when(a["intensity"] > b["intensity"], 1).otherwise(0)))


def by_intensity(peaks: Column) -> Column:
    """Falling intensity; equal intensities by rising m/z."""
    return F.array_sort(peaks, lambda a, b: F.when(a["intensity"] > b["intensity"], -1).when(a["intensity"] < b["intensity"], 1).otherwise(F.when(a["mz"] < b["mz"], -1).when(a["mz"] > b["mz"], 1).otherwise(0)))


def mz_range(peaks: Column, low: float, high: float) -> Column:
    return F.filter(peaks, lambda p: p["mz"].between(low, high))


def is_valid(peaks: Column, min_peaks: int, min_range: float) -> Column:
    """Enough peaks over a wide enough range; never null."""
    wide = F.try_element_at(peaks, F.lit(-1))["mz"] - F.try_element_at(peaks, F.lit(1))["mz"] >= min_range
    return F.coalesce((F.size(peaks) >= min_peaks) & wide, F.lit(False))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def round_and_merge(peaks: Column, decimals: int) -> Column:
    """m/z rounded, peaks of equal m/z merged to their summed intensity, at a cost in proportion to the peaks once they are sorted."""
    rounded = F.transform(peaks, lambda p: p.withField("mz", F.round(p["mz"], decimals)))

    def runs(r: Column) -> Column:
        order = F.array_sort(F.transform(r, lambda p, i: F.struct(p["mz"].alias("mz"), i.alias("i"))))
        return bound(order, lambda s: bound(starts(s), lambda at: F.transform(at, lambda lo, k: merged(r, F.slice(s, lo + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - lo)))))

    def starts(s: Column) -> Column:
        return F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~F.get(s, i - 1)["mz"].eqNullSafe(x["mz"]), i)), lambda i: i.isNotNull())

    def merged(r: Column, same: Column) -> Column:
        return F.get(r, F.get(same, F.lit(0))["i"]).withField("intensity", F.aggregate(same, F.lit(0.0), lambda a, x: a + F.get(r, x["i"])["intensity"].cast("double")))

    return bound(rounded, runs)


def without_precursor(peaks: Column, precursor_mz: Column, charge: Column, tolerance: float, isotopes: int = 2) -> Column:
    """Peaks not within ``tolerance`` of the precursor at any charge up to its own, with up to ``isotopes`` neutrons more."""
    proton, neutron = 1.00727646687, 1.00335483507  # masses of the proton and of the isotope step (fixed values)
    mass = (precursor_mz - proton) * charge
    at = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(charge, F.lit(1))), lambda z: F.transform(F.sequence(F.lit(0), F.lit(isotopes)), lambda i: (mass + i * neutron) / z + proton)))
    return F.filter(peaks, lambda p: ~F.exists(at, lambda m: F.abs(p["mz"] - m) <= tolerance))


def filter_intensity(peaks: Column, least_share: float, most: int) -> Column:
    """The ``most`` strongest peaks above a share of the strongest, by m/z."""
    strongest = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return by_mz(F.slice(by_intensity(F.filter(peaks, lambda p: p["intensity"] > strongest * least_share)), 1, most))


def scale(peaks: Column, kind: str | None, most: int) -> Column:
    """Root scaling, or ranks: the strongest peak gets ``most``, the next one less."""
    if kind is None:
        return peaks
    if kind in ("root", "sqrt"):
        return with_intensity(peaks, lambda p: F.sqrt(p["intensity"]))
    return by_mz(F.transform(by_intensity(peaks), lambda p, i: p.withField("intensity", (F.lit(most) - i).cast("double"))))


def normalise(peaks: Column) -> Column:
    """Intensities of Euclidean length one."""
    length = F.sqrt(total(F.transform(peaks, lambda p: p["intensity"] * p["intensity"])))
    return with_intensity(peaks, lambda p: p["intensity"] / length)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def process(spectra: DataFrame, cfg: SearchConfig, is_library: bool) -> DataFrame:
    """Valid spectra with cleaned, scaled and normalised peaks; a spectrum that fails any check is dropped.

    The steps are one expression, each step evaluated once and only if the check after the last holds.
    """
    most = cfg.max_peaks_used_library if is_library else cfg.max_peaks_used
    steps = [lambda p: mz_range(by_mz(p), cfg.min_mz, cfg.max_mz)]
    if cfg.resolution is not None:
        steps.append(lambda p: round_and_merge(p, cfg.resolution))
    if cfg.remove_precursor:
        steps.append(lambda p: without_precursor(p, F.col("precursor_mz"), F.col("precursor_charge"), cfg.remove_precursor_tolerance))
    steps.append(lambda p: filter_intensity(p, cfg.min_intensity, most))

    def chain(peaks: Column, left: list) -> Column:
        if not left:
            return let(scale(peaks, cfg.scaling, most), normalise)
        return let(left[0](peaks), lambda p: F.when(is_valid(p, cfg.min_peaks, cfg.min_mz_range), chain(p, left[1:])))

    return spectra.withColumn("peaks", chain(F.col("peaks"), steps)).where(F.col("peaks").isNotNull())


def expand_charge(queries: DataFrame, charges: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Spectra of unknown charge once for each usual charge."""
    options = F.when(F.col("precursor_charge").isNull(), F.array(*map(F.lit, charges))).otherwise(F.array("precursor_charge"))
    return queries.withColumn("precursor_charge", F.explode(options))
