"""Periodic runs of words: the sequence of a text's word ids against itself at every shift.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal), of at least
``min_exp`` periods and ``min_length`` words, that can't be extended on either side. It shows as a stretch of
equality between the ids and the ids shifted by ``q``, so all shifts up to ``n / min_exp`` are compared.

A shift ``q`` is compared first at the multiples of ``q``, for all shifts in one vectorised pass (``n ln n`` places in
all): a run covers ``min_exp - 1`` equal ones of these in a row, so shifts without such a row have none. Shifts with one are
compared over the whole text and their stretches measured. A stretch is brought to its smallest period by
the prime factors of its shift, and multiples of a known period inside its run are passed over.

Texts beyond ``long`` bytes are cut into ranges of shifts of about equal work, which Spark deals out; every
range names its runs with their smallest periods, so the ranges' results unite without regard to each other. A
text has at most ``MOST_RANGES`` ranges, since each reads the whole text.

Null and empty texts and texts of white space have no words: no run, empty collapsed text. Repeated rows and
repeated ids, null ids included, each give their row; other columns are ignored whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import slices

MIN_EXP, MIN_LENGTH = 4, 6
LONG = 120_000  # bytes of a text beyond which its shifts are dealt out
RANGE, MOST_RANGES = 120_000, 64  # places compared by a range; ranges of a text
BLOCK = 1 << 20  # places compared at a time

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))


def suspects(ids: np.ndarray, low: int, high: int, chain: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shift, places) where ``chain`` multiples of a shift in a row equal the next multiple, for shifts from ``low`` to below ``high``."""
    n = len(ids)
    while low < high:
        lags = np.arange(low, high)
        ends = np.cumsum((n - 1) // lags)
        take = max(1, int(np.searchsorted(ends, BLOCK, "right")))
        lags, ends = lags[:take], ends[:take]
        low += take
        counts = np.diff(ends, prepend=0)
        lag = np.repeat(lags, counts)
        at = (np.arange(len(lag)) - np.repeat(ends - counts, counts)) * lag
        equal = np.flatnonzero(ids[at] == ids[at + lag])
        if len(equal) < chain:
            continue
        first, last = equal[: len(equal) - chain + 1], equal[chain - 1 :]
        first = first[(last - first == chain - 1) & (lag[first] == lag[last])]
        cuts = np.flatnonzero(np.diff(lag[first])) + 1
        for places in np.split(first, cuts):
            if len(places):
                yield int(lag[places[0]]), at[places]


def smallest_period(ids: np.ndarray, start: int, end: int, period: int) -> int:
    """The smallest period of ``ids[start:end]``, which has ``period`` and is at least twice as long."""
    left, f = period, 2
    while left > 1:
        f = f if f * f <= left else left
        if left % f:
            f += 1
            continue
        left //= f
        if (ids[start : end - period // f] == ids[start + period // f : end]).all():
            period //= f
    return period


def find_runs(ids: np.ndarray, low: int = 1, high: int | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[Run]:
    """(start, length, period) of the runs that shifts from ``low`` to below ``high`` (all, if None) show, sorted."""
    n, chain = len(ids), max(1, min_exp - 1)
    found: set[Run] = set()
    known = (np.empty(0, np.int64),) * 3  # starts, ends, periods, by start
    for lag, places in suspects(ids, low, min(n // min_exp + 1, high or n), chain):
        if len(found):
            multiple = lag % known[2] == 0
            if multiple.any():
                starts, ends = known[0][multiple], np.maximum.accumulate(known[1][multiple])
                k = np.searchsorted(starts, places, "right") - 1
                places = places[(k < 0) | (ends[k] <= places + chain * lag)]
        if not len(places):
            continue
        edges = np.concatenate([[-1], np.flatnonzero(ids[:-lag] != ids[lag:]), [n - lag]])
        lengths = np.diff(edges) - 1
        fresh = False
        for k in np.flatnonzero(lengths >= max(min_length, min_exp * lag) - lag).tolist():
            start, size = int(edges[k]) + 1, int(lengths[k]) + lag
            run = (start, size, smallest_period(ids, start, start + size, lag))
            fresh |= run not in found
            found.add(run)
        if fresh:
            rows = np.array(sorted(found), np.int64)
            known = (rows[:, 0], rows[:, 0] + rows[:, 1], rows[:, 2])
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by a space, without those that lie in a run after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _runs_array(rows: list[list[Run]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)])
    flat = np.array([r for row in rows for r in row], np.int64).reshape(-1, 3)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))


def _words(doc_id: int | None, text: bytes | None, rewrite: Rewrite | None) -> list[bytes]:
    words = (text or b"").split()
    return rewrite(doc_id, words) if rewrite else words


def periodic_runs(docs: DataFrame, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None, long: int = LONG, work: int = RANGE) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row: runs by start and period, and the text without repeated periods.

    ``rewrite`` of an id and its words gives the words to search instead.
    """
    if min_exp < 2:
        raise ValueError("a run needs at least two periods")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shape = f"doc_id long, n_words long, runs {RUNS}, collapsed binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4000, 16_000_000):
            ids = b.column(0).to_pylist()
            words = [_words(i, t, rewrite) for i, t in zip(ids, b.column(1).to_pylist())]
            runs = [find_runs(word_ids(w), min_exp=min_exp, min_length=min_length) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), _runs_array(runs), pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 4000, 16_000_000):
            rows = zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)))
            runs = [find_runs(word_ids(_words(i, t, rewrite)), lo, hi, min_exp, min_length) for i, t, lo, hi in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _runs_array(runs)], ["doc_id", "digest", "runs"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4000, 16_000_000):
            words = [_words(i, t, rewrite) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            runs = [sorted(((r["start"], r["length"], r["period"]) for r in row or []), key=lambda r: (r[0], r[2])) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), _runs_array(runs), pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()), b.column(3)], ["doc_id", "n_words", "runs", "collapsed", "copies"])

    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    short = own.where(~is_long).mapInArrow(whole, shape)
    # equal rows are searched once
    large = own.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    words = (F.octet_length("text") + 1) / 2  # at most
    lags = F.floor(words / min_exp) + 1
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(words * F.log(words) / work)).cast("int")
    marks = F.transform(F.sequence(F.lit(0), ranges), lambda k: F.floor(F.pow(lags + 1, k / ranges)).cast("long"))
    dealt = large.select("doc_id", "digest", "text", F.explode(F.arrays_zip(F.slice(marks, 1, ranges).alias("low"), F.slice(marks, 2, ranges).alias("high"))).alias("r")).select("doc_id", "digest", "text", "r.low", "r.high").where("low < high")
    seen = dealt.repartition("doc_id", "digest", "low").mapInArrow(part, f"doc_id long, digest string, runs {RUNS}")
    united = seen.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")).toDF("same_id", "same", "runs")  # runs of one text
    joined = large.join(united, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same")))
    done = joined.select("doc_id", "text", "runs", "copies").mapInArrow(finish, f"{shape}, copies long")
    again = done.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return short.unionByName(again).withColumn("collapsed", F.col("collapsed").cast("string"))


def listed(runs: Column) -> Column:
    """``start,length,period`` of each run, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def strongest(runs: Column) -> Column:
    """The run of most periods (exact fractions), then of smallest start and period; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))
