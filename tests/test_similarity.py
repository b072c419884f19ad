"""Golden values of the similarity measures."""

import math

import pytest
from pyspark.sql import functions as F

from ionweave.functions import similarity as sim

# Peaks (m/z, intensity) of simulated spectra, and measured goldens (fixed values).
SAME = [(138.066, 0.03675187), (235.119, 0.41731364), (398.182, 0.00473946), (511.266, 0.00332476), (640.309, 0.00320261), (755.336, 0.00670335), (175.119, 0.40390085), (290.146, 0.09983288), (419.188, 0.01661951), (532.273, 0.05734070), (695.336, 0.22102276), (792.389, 0.77388125)]
LEFT = [(116.034, 0.0), (229.118, 0.24194328), (286.140, 0.13076611), (385.208, 0.02920486), (498.292, 0.00316699), (613.319, 0.00426051), (760.388, 0.00131579), (147.113, 0.33024615), (294.181, 0.54129990), (409.208, 0.24971860), (522.292, 0.34601156), (621.361, 0.05075963), (678.382, 0.58027458), (791.466, 0.00585116)]
RIGHT = [(58.0287, 0.0), (173.056, 0.12522728), (286.140, 0.18020111), (385.208, 0.04328780), (498.292, 0.00542208), (645.361, 0.00330758), (760.388, 0.00208561), (147.113, 0.26473886), (262.140, 0.30046007), (409.208, 0.56388106), (522.292, 0.49369887), (621.361, 0.43157844), (734.445, 0.20395883), (849.472, 0.00216236)]
PARTIAL = [(1, 1), (3, 4), (5, 5), (6, 6), (7, 7), (8, 8), (10, 9), (12, 12)]
GOLDEN = {  # full match, no match, partial match; then the same for the five strongest peaks (None: not defined)
    "cosine": (1, 0, 0.44582117, 1, 0, 0.85880862),
    "n_matched_peaks": (12, 0, 8, 5, 0, 4),
    "frac_n_peaks_query": (1, 0, 8 / 14, None, None, None),
    "frac_n_peaks_library": (1, 0, 8 / 14, 1, 0, 4 / 5),
    "frac_intensity_query": (1, 0, 0.45378598, None, None, None),
    "frac_intensity_library": (1, 0, 0.75759018, 1, 0, 0.85374497),
    "spectral_contrast_angle": (1, 0, 0.29417655, 1, 0, 0.65758974),
    "kendalltau": (19.29406731, 0, 4.25896654, 4.09434456, 0, 0),
    "ms_for_id_v1": (1000, 0, 21.03216848, 1000, 0, 10.48956478),
    "ms_for_id_v2": (154.45107128, 0, 30.03222119, None, None, None),
    "manhattan": (0, math.inf, 2.98346427, None, None, None),
    "euclidean": (0, math.inf, 1.05278566, None, None, None),
    "chebyshev": (0, math.inf, 0.5802746, None, None, None),
    "pearsonr": (1, 0, 0.69570652, 1, 0, 0.24177300),
    "spearmanr": (1, 0, 0.59933680, 1, 0, 0.19999999),
    "braycurtis": (0, 1, 0.58102504, None, None, None),
    "canberra": (0, math.inf, 12.30376030, None, None, None),
    "ruzicka": (1, 0, 0.26500210, None, None, None),
    "scribe_fragment_acc": (10, 0, 0.86739458, 10, 0, 1.02137350),
}
HYPERGEOMETRIC = (100, 4.27409242, 57.90893056, 100, 6.32786559, 42.94264115)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(0, SAME, SAME, [(i, i) for i in range(12)]), (1, SAME, RIGHT, []), (2, LEFT, RIGHT, PARTIAL)]
    peak = "array<struct<mz:double,intensity:double>>"
    # places refer to peaks sorted by m/z
    rows = [(k, sorted(q), sorted(lib), m) for k, q, lib, m in rows]
    return spark.createDataFrame(rows, f"k int, q {peak}, l {peak}, m array<struct<q:int,l:int>>").coalesce(1).persist()


def values(cases, measure):
    return [r[0] for r in cases.orderBy("k").select(measure).collect()]


def close(got, want, what):
    slack = 1e-4 if "spectral_contrast_angle" in str(what) else 2e-5  # the arc cosine at 1 doubles the digits lost
    assert (math.isinf(got) and math.isinf(want)) or got == pytest.approx(want, rel=slack, abs=slack), (what, got, want)


def test_goldens(cases):
    for top, at in ((None, 0), (5, 3)):
        a = sim.Aligned(F.col("q"), F.col("l"), F.col("m"), top)
        named = {n: getattr(sim, n)(a) for n, g in GOLDEN.items() if g[at] is not None}
        named["hypergeometric"] = sim.hypergeometric_score(a, 101, 1500, 0.1)
        got = cases.orderBy("k").select(*[c.cast("double").alias(n) for n, c in named.items()]).collect()
        for name in named:
            for k in range(3):
                close(got[k][name], (HYPERGEOMETRIC if name == "hypergeometric" else GOLDEN[name])[at + k], (name, top, k))


def test_errors_and_entropy(cases):
    a = sim.Aligned(F.col("q"), F.col("l"), F.col("m"))
    for axis, want in (("mz", (0, math.inf, 0)), ("intensity", (0, math.inf, 0.03405894))):
        for got, w in zip(values(cases, sim.mean_squared_error(a, axis)), want):
            close(got, w, axis)
    for weighted, want in ((False, (1, 0, 0.53600209)), (True, (1, 0, 0.59836031))):
        for got, w in zip(values(cases, sim.entropy(a, weighted)), want):
            close(got, w, weighted)
    with pytest.raises(ValueError):
        sim.mean_squared_error(a, "charge")
    top = sim.Aligned(F.col("q"), F.col("l"), F.col("m"), 5)
    for name in ("frac_n_peaks_query", "frac_intensity_query", "ms_for_id_v2", "manhattan", "euclidean", "chebyshev", "braycurtis", "canberra", "ruzicka", "entropy"):
        with pytest.raises(NotImplementedError):
            getattr(sim, name)(top)


def flat(spark, q, lib, matches):
    peaks = lambda v: [(100.0 + k, x) for k, x in enumerate(v)]
    kind = "array<struct<mz:double,intensity:double>>"
    return spark.createDataFrame([(peaks(q), peaks(lib), [(a, b, 1.0) for a, b in matches])], f"q {kind}, l {kind}, m array<struct<q:int,l:int,w:double>>")


@pytest.mark.parametrize("top", [None, 5])
@pytest.mark.parametrize("q,lib", [([0.4] * 6, [0.4] * 6), ([0.4] * 6, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.3] * 6)])
def test_equal_intensities_do_not_correlate(spark, q, lib, top):
    df, a = sim.Aligned.on(flat(spark, q, lib, [(k, k) for k in range(6)]), "q", "l", "m", top)
    assert df.select(sim.pearsonr(a), sim.spearmanr(a)).first()[:] == (0.0, 0.0)


def test_features_of_zero_and_equal_intensities(spark):
    df = flat(spark, [0.0] * 6, [0.0] * 6, [(k, k) for k in range(6)]).unionByName(flat(spark, [0.4] * 6, [0.4] * 6, [(k, k) for k in range(6)]))
    got, names = sim.with_features(df, "q", "l", "m", 11.0, 2010.0, 0.04)
    zero, equal = sorted(got.select(*names).collect(), key=lambda r: r["frac_intensity_query"])
    assert zero["cosine_top"] == zero["frac_intensity_library"] == zero["frac_intensity_library_top"] == zero["ruzicka"] == 0.0 and zero["braycurtis"] == 1.0
    assert equal["frac_intensity_library"] == 1.0 and equal["pearsonr_top"] == equal["spearmanr"] == 0.0
