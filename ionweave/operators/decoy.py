"""Decoy spectra: shuffled peptides with their annotated peaks moved to the shuffled fragments' m/z."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionweave.functions.sequences import MONOISOTOPIC, PROTON, WATER
from ionweave.sources.export import ROWS, by_rows

FIXED = "KRP"
_MOD = re.compile(r"([A-Z])(?:\[([^\]]*)\])?")


def similarity(a: str, b: str) -> float:
    """One less the residues outside a longest common subsequence of both, over the length."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = left = (1 << len(b)) - 1  # a cleared bit is a residue of the common subsequence
    for x in a:
        met = left & at.get(x, 0)
        left = (left + met | left - met) & full
    return 1 - (len(a) + len(b) - 2 * (len(b) - left.bit_count())) / max(len(a), 1)


def shuffle(sequence: str, fixed: str = FIXED, most: float = 0.7, seed: int = 42, tries: int = 10) -> tuple[str, list[int]]:
    """(decoy, origin of each place). Residues in ``fixed`` and the last stay; the first of ``tries`` that differs enough wins, else the best.

    Depends on sequence and seed only. Where nothing differs, movable residues are reversed.
    """
    n = len(sequence)
    free = [i for i in range(n - 1) if sequence[i] not in fixed]
    rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{sequence}".encode()).digest()[:8], "big"))
    best: tuple[float, list[int]] | None = None
    for _ in range(tries):
        moved = free[:]
        rng.shuffle(moved)
        origin = list(range(n))
        for place, source in zip(free, moved):
            origin[place] = source
        alike = similarity("".join(sequence[i] for i in origin), sequence)
        if best is None or alike < best[0]:
            best = (alike, origin)
        if alike <= most:
            break
    if best is None or best[0] >= 1:
        origin = list(range(n))
        for place, source in zip(free, reversed(free)):
            origin[place] = source
        best = (0.0, origin)
    return "".join(sequence[i] for i in best[1]), best[1]


def residues(peptide: str) -> list[tuple[str, float]]:
    """(residue, mass with its modification) of a ProForma-like sequence; named modifications add by table."""
    named = {"Carbamidomethyl": 57.02146372, "Oxidation": 15.99491462, "Acetyl": 42.01056468, "Phospho": 79.96633041}  # fixed values
    out = []
    for aa, mod in _MOD.findall(peptide):
        delta = 0.0
        if mod:
            try:
                delta = float(mod)
            except ValueError:
                delta = named.get(mod, 0.0)
        out.append((aa, MONOISOTOPIC.get(aa, 0.0) + delta))
    return out


#: Neutral losses of fragments and their masses (fixed values).
LOSSES = {
    "H": 1.007825, "NH3": 17.026549, "H2O": 18.010565, "CO": 27.994915, "CO2": 43.989829, "HCONH2": 45.021464, "HCOOH": 46.005479, "CH4OS": 63.998285,
    "SO3": 79.956818, "HPO3": 79.966331, "C2H5NOS": 91.009195, "C2H4O2S": 91.993211, "H3PO4": 97.976896,
}


def fragments(masses: list[float], charge: int, losses: dict[str, float] | None = None) -> dict[tuple[str, int, int, str], float]:
    """m/z of all a, b and y fragments and the precursor by (type, index, charge, loss); the loss of whole ones is empty."""
    out, n, whole = {}, len(masses), sum(masses)
    run = 0.0
    for i in range(1, n):
        run += masses[i - 1]
        for z in range(1, max(1, charge - 1) + 1):
            out["b", i, z, ""] = run / z + PROTON
            out["a", i, z, ""] = (run - 27.99491462) / z + PROTON  # less carbon monoxide
            out["y", n - i, z, ""] = (whole - run + WATER) / z + PROTON
    for z in range(1, charge + 1):
        out["p", n, z, ""] = (whole + WATER) / z + PROTON
    for (kind, i, z, _), mz in list(out.items()):
        for name, loss in (losses or {}).items():
            if mz * z > loss:
                out[kind, i, z, name] = mz - loss / z
    return out


@lru_cache(4096)
def _layout(n: int, charge: int) -> tuple[list[tuple[str, int, int, str]], np.ndarray, np.ndarray]:
    """(keys, charge and loss of each) of the fragments with and without losses of ``n`` residues, as ``_masses`` lists them."""
    keys = [(kind, n - i if kind == "y" else i, z, "") for z in range(1, max(1, charge - 1) + 1) for kind in "bay" for i in range(1, n)]
    keys += [("p", n, z, "") for z in range(1, charge + 1)]
    keys += [(*k[:3], name) for name in LOSSES for k in keys[:]]
    return keys, np.array([k[2] for k in keys]), np.array([LOSSES.get(k[3], 0.0) for k in keys])


def _masses(masses: list[float], charge: int) -> np.ndarray:
    """m/z of ``fragments`` with ``LOSSES`` in the order of ``_layout``; not a number for losses that a fragment can't have."""
    _, z, loss = _layout(len(masses), charge)
    run, whole = np.cumsum(masses)[:-1], sum(masses)
    own = np.concatenate([run, run - 27.99491462, whole - run + WATER])
    m = len(z) // (len(LOSSES) + 1)
    base = np.concatenate([np.tile(own, max(1, charge - 1)), np.full(charge, whole + WATER)]) / z[:m] + PROTON
    every = np.tile(base, len(LOSSES) + 1)
    out = np.where(every * z > loss, every - loss / z, np.nan)
    out[:m] = base
    return out


def reposition(peptide: str, charge: int, peaks: list[tuple[float, float]], ppm: float, seed: int = 42) -> tuple[str, list[tuple[float, float]]]:
    """The decoy's sequence and peaks: annotated peaks keep their mass error at the moved fragment; others stay.

    A peak is the whole fragment nearest to it within the tolerance, else the nearest one with a neutral loss.
    """
    rows = residues(peptide)
    _, origin = shuffle("".join(a for a, _ in rows), seed=seed)
    moved = [rows[i] for i in origin]
    names = [m.group(0) for m in _MOD.finditer(peptide)]
    keys = _layout(len(rows), charge)[0]
    old, new = _masses([m for _, m in rows], charge), None
    known = np.argsort(old)  # those that can't be lie at the end
    places, at = old[known], np.array([mz for mz, _ in peaks], float)
    reach = at * ppm * 1.1e-6
    lo, hi = np.searchsorted(places, at - reach, "left").tolist(), np.searchsorted(places, at + reach, "right").tolist()
    out = []
    for (mz, intensity), i, j in zip(peaks, lo, hi):
        if i < j:
            new = _masses([m for _, m in moved], charge) if new is None else new
            close = [(float(old[k]), int(k)) for k in known[i:j] if new[k] == new[k]]
            near = min(((keys[k][3] != "", abs(mz - t), keys[k], k) for t, k in close if abs(mz - t) <= t * ppm * 1e-6), default=None)
            mz = mz if near is None else max(float(new[near[3]]) + mz - float(old[near[3]]), 0.0)
        out.append((mz, intensity))
    return "".join(names[i] for i in origin), sorted(out)


def with_decoys(library: DataFrame, ppm: float = 10.0, seed: int = 42) -> DataFrame:
    """The library and a decoy for each spectrum with a peptide (``DECOY_`` before the id, same precursor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches, ROWS):
            column = dict(zip(b.schema.names, b.columns))
            peaks, inner = column["peaks"].flatten(), column["peaks"].type.value_type
            both = list(zip(*(peaks.field(c).cast(pa.float64()).to_pylist() for c in ("mz", "intensity"))))
            sizes = np.cumsum([0, *column["peaks"].value_lengths().to_pylist()]).tolist()
            spectra = zip(column["peptide"].to_pylist(), column["precursor_charge"].to_pylist(), sizes, sizes[1:])
            made = [reposition(p, int(z or 1), both[lo:hi], ppm, seed) for p, z, lo, hi in spectra]
            flat = {"mz": [m for _, p in made for m, _ in p], "intensity": [i for _, p in made for _, i in p]}
            n = len(flat["mz"])
            parts = [pa.array(flat[f.name], pa.float64()).cast(f.type, safe=False) if f.name in flat else pa.nulls(n, f.type) for f in inner]
            ends = pa.array(np.cumsum([0, *(len(p) for _, p in made)]), pa.int32())
            column["id"] = pa.array(["DECOY_" + x for x in column["id"].to_pylist()], column["id"].type)
            column["peptide"] = pa.array([p for p, _ in made], column["peptide"].type)
            column["peaks"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=[inner.field(k) for k in range(inner.num_fields)]))
            column["is_decoy"] = pa.array([True] * b.num_rows)
            yield pa.RecordBatch.from_arrays([column[c] for c in b.schema.names], b.schema.names)

    own = library.where("peptide is not null and not is_decoy and id is not null")
    return library.unionByName(own.mapInArrow(run, own.schema))
