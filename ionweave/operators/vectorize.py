"""Peak lists as fixed-length vectors: m/z bins, hashed to slots, summed and normalised."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimensions(low: float, high: float, width: float) -> tuple[int, float, float]:
    """(number of bins, start, end) of the binned m/z range."""
    start, end = low - low % width, high + width - high % width
    return round((end - start) / width), start, end


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 x86 32-bit, unsigned."""
    mask = 0xFFFFFFFF

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def slot_of(bin_index: int, hash_len: int) -> int:
    return murmur3(str(bin_index).encode()) % hash_len


@lru_cache(maxsize=4)
def slot_table(low: float, high: float, width: float, hash_len: int | None) -> np.ndarray:
    """The slot of every bin; without ``hash_len`` a bin is its own slot. As many as there are bins, whatever the data."""
    n, _, _ = dimensions(low, high, width)
    return np.arange(n + 1) if hash_len is None else np.array([slot_of(b, hash_len) for b in range(n + 1)])


def bins_of(mz: np.ndarray, start: float, width: float) -> np.ndarray:
    """Floor division of doubles, as the remainder defines it."""
    x = mz - start
    return np.rint((x - np.fmod(x, width)) / width).astype(np.int64)


def _summed(peaks: pa.Array, start: float, width: float, slots: np.ndarray, norm: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight) of a batch of peak lists, by row and slot."""
    peaks = peaks.combine_chunks() if isinstance(peaks, pa.ChunkedArray) else peaks
    sizes = np.diff(np.asarray(peaks.offsets))
    flat = peaks.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    mz, weight = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("mz", "intensity"))
    key, place = np.unique(row * (int(slots.max()) + 1) + slots[bins_of(mz, start, width)], return_inverse=True)
    w = np.bincount(place, weight, len(key))
    row, slot = np.divmod(key, int(slots.max()) + 1)
    if norm and len(w):
        w = w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
    return row, slot, w


def vectorise(spectra: DataFrame, low: float, high: float, width: float, hash_len: int | None, norm: bool = True) -> DataFrame:
    """``(id, entries)``: sorted ``(slot, weight)`` of each spectrum that has peaks; with ``hash_len`` None slots are bins. No shuffle."""
    _, start, _ = dimensions(low, high, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slot_table(low, high, width, hash_len)
        for b in batches:
            row, slot, w = _summed(b.column(1), start, width, slots, norm)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            entries = pa.StructArray.from_arrays([pa.array(slot, pa.int32()), pa.array(w)], ["slot", "w"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["id", "entries"])

    return spectra.select("id", "peaks").where(F.size("peaks") > 0).mapInArrow(run, f"id {dict(spectra.dtypes)['id']}, entries array<struct<slot:int,w:double>>")


def dense_vectors(spectra: DataFrame, low: float, high: float, width: float, hash_len: int | None) -> DataFrame:
    """``(id, charge, vec)``: whole normalised vectors of spectra that have peaks, in one step and without a shuffle."""
    n, start, _ = dimensions(low, high, width)
    size = hash_len or n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slot_table(low, high, width, hash_len)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                row, slot, w = _summed(b.column(2), start, width, slots, True)
                out = np.zeros((b.num_rows, max(size, int(slots.max()) + 1)), np.float32)
                out[row, slot] = w
                ends = pa.array(np.arange(b.num_rows + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(out[:, :size]).ravel()))], ["id", "charge", "vec"])

    narrow = spectra.select("id", F.col("precursor_charge").cast("int").alias("charge"), "peaks").where(F.size("peaks") > 0)
    return narrow.mapInArrow(run, f"id {dict(spectra.dtypes)['id']}, charge int, vec array<float>")


def dense(entries: Column, size: int) -> Column:
    """Sparse entries as an array of doubles."""
    weight = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(weight, i), F.lit(0.0)))
