"""Similarities as SQL functions: ``CREATE TEMPORARY FUNCTION ... RETURN``, so plain SQL and views can use them.

All take both peak lists and the matches, as ``block_match.best_in_window`` gives them: ``q_peaks``, ``l_peaks`` of ``(mz, intensity)``
and ``matches`` of ``(q, l, w)`` with places from 0. The optimiser puts their expressions in place of the calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PEAKS, MATCHES = "ARRAY<STRUCT<mz: DOUBLE, intensity: DOUBLE>>", "ARRAY<STRUCT<q: INT, l: INT, w: DOUBLE>>"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (a, v) -> a + v)"


_Q, _L = "q_peaks[m.q].intensity", "l_peaks[m.l].intensity"
_OVER = lambda expression: _sum(f"transform(matches, m -> {expression})")
_ALONE_Q = "filter(transform(q_peaks, (p, i) -> IF(exists(matches, m -> m.q = i), NULL, p.intensity)), v -> v IS NOT NULL)"
_ALONE_L = "filter(transform(l_peaks, (p, i) -> IF(exists(matches, m -> m.l = i), NULL, p.intensity)), v -> v IS NOT NULL)"
_ALL_Q, _ALL_L = _sum("transform(q_peaks, p -> p.intensity)"), _sum("transform(l_peaks, p -> p.intensity)")
_SQUARES = lambda values: _sum(f"transform({values}, v -> v * v)")

#: Name and expression over ``q_peaks, l_peaks, matches``.
FUNCTIONS = {
    "similarity_cosine": _OVER(f"{_Q} * {_L}"),
    "similarity_n_matched": "CAST(size(matches) AS DOUBLE)",
    "similarity_frac_n_query": "size(matches) / size(q_peaks)",
    "similarity_frac_n_library": "size(matches) / size(l_peaks)",
    "similarity_frac_intensity_query": f"{_OVER(_Q)} / {_ALL_Q}",
    "similarity_frac_intensity_library": f"{_OVER(_L)} / {_ALL_L}",
    "similarity_mse_mz": f"{_OVER('power(q_peaks[m.q].mz - l_peaks[m.l].mz, 2)')} / size(matches)",
    "similarity_mse_intensity": f"{_OVER(f'power({_Q} - {_L}, 2)')} / size(matches)",
    "similarity_contrast_angle": f"1 - 2 * acos(least(greatest({_OVER(f'{_Q} * {_L}')}, 0D), 1D)) / pi()",
    "similarity_manhattan": f"{_OVER(f'abs({_Q} - {_L})')} + {_sum(_ALONE_Q)} + {_sum(_ALONE_L)}",
    "similarity_euclidean": f"sqrt({_OVER(f'power({_Q} - {_L}, 2)')} + {_SQUARES(_ALONE_Q)} + {_SQUARES(_ALONE_L)})",
    "similarity_chebyshev": f"array_max(concat(transform(matches, m -> abs({_Q} - {_L})), {_ALONE_Q}, {_ALONE_L}))",
    "similarity_scribe": f"ln(1 / ({_OVER(f'power({_Q} - {_L}, 2)')} + {_SQUARES(_ALONE_L)}))",
}


def register(spark: SparkSession) -> list[str]:
    """Defines all similarity functions in the session; returns their names."""
    for name, expression in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(q_peaks {PEAKS}, l_peaks {PEAKS}, matches {MATCHES}) RETURNS DOUBLE RETURN {expression}")
    return list(FUNCTIONS)


def plain_peaks(best: DataFrame) -> DataFrame:
    """``best`` with peaks of m/z and intensity only, as the functions take them."""
    kind = "array<struct<mz:double,intensity:double>>"
    narrow = lambda c: f"CAST(transform({c}, p -> named_struct('mz', p.mz, 'intensity', p.intensity)) AS {kind}) AS {c}"
    return best.selectExpr(*[narrow(c) if c in ("q_peaks", "l_peaks") else f"`{c}`" for c in best.columns])
