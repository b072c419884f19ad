"""LM scoring by a hierarchical Pitman-Yor model of word triples.

Three levels of Chinese restaurants: one for every pair of words before a token, one for every word
before it, which all pairs ending in that word share as parent, and one of all words, which every
one-word restaurant shares; its tables draw from a uniform base over the vocabulary and one unknown
word. Contexts are exact (64-bit word hashes): their number grows with the corpus.

Seating is sampled by Gibbs, a dish of a restaurant at a time: its tables leave the restaurant and the
parent's dish, and its customers are seated anew given all others. Up to ``EXACT`` customers the
number of tables is drawn from its conditional (generalised Stirling numbers); beyond, further customers
come one by one by the predictive rule and the whole sequence is accepted or refused by Metropolis-Hastings,
which has the same conditional as its limit (runs of customers without a new table are drawn at once,
from their exact chance). Dishes are in ``COLOURS`` classes; totals are brought up to date after each.
Discounts and strengths are drawn on a grid by their likelihood at every exchange. Predictive
probabilities are averaged over ``SAMPLES`` seatings.

Tokens travel once, as compressed blocks, to the shard of the word before them, which so holds
all restaurants of that word. Words that would fill a shard alone are dealt by the pair before the token
(a sample decides which; that moves work); their one-word restaurants are spread over shards and kept,
like the restaurant of all words, in buckets by dish. Shards and buckets exchange customers twice; between
exchanges a shard sees its own changes at once and others' as of the exchange. Nothing of the size of
the vocabulary is broadcast or collected.

Rows are scored one by one, also rows with equal ids; null and empty texts are one end token; long texts are
counted in runs of ``CHUNK`` tokens; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import cut

EXACT, SAMPLES, BURN_IN, COLOURS = 64, 3, 2, 3
CHUNK, FLUSH, SHARD_CHARS, LEAST_SHARDS, SAMPLE_CHARS, COMMON = 500_000, 20_000_000, 16_000_000, 24, 8_000_000, 60_000
PARTS = 2  # in which texts are counted: only a part's shuffle files lie beside the blocks
START = 0x51ED270B27B4F3A1  # hash of the place before a text
#: Discounts and strengths that can be drawn.
DISCOUNTS = [k / 20 for k in range(1, 20)]
STRENGTHS = [0.05, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 100.0]
OUT = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double"
FLOW = "kind int, key long, sender long, blob binary, nums array<double>"
#: Kinds of rows between shards and buckets.
TO_BUCKET, TO_SHARD, STATE, NUMBERS, CONTEXT = range(5)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64: well-mixed 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, step: int) -> np.ndarray:
    """Random numbers in (0, 1) that depend on key and step only."""
    return ((_mix(keys ^ _mix(np.array([step], np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def squeeze(arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(tuple((a.dtype.str, np.ascontiguousarray(a).tobytes()) for a in arrays), 5))


def expand(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, d) for d, b in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def small(a: np.ndarray) -> np.ndarray:
    """The array in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


# --- counting ---------------------------------------------------------------------------------


def planes(a: np.ndarray) -> np.ndarray:
    """The four bytes of small numbers apart, which packs well: the upper ones are mostly zero."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T


def numbers_of(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(4, -1).T).view("<u4").ravel()


def steps(hashes: np.ndarray) -> np.ndarray:
    """Rising 64-bit numbers as differences, their bytes apart."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T


def hashes_of(b: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(b.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts on end, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.string()), "")))
    words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    some = pc.greater(pc.binary_length(words), 0)  # space at a text's ends leaves empty ones
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), kept[ends]


def _count(shards: np.ndarray, hot: np.ndarray, common: list[bytes]):
    """Blocks of (pair before, word, row, count), a row for each shard and flush, in the order of the texts.

    ``common`` words, the empty one first, go by their place in the list after ``START``; others by hash.
    """
    slots = len(common) + 2  # the end, the place before a text, the common words
    first_words = pa.array(common, pa.binary()).view(pa.string())
    common_hashes = np.array([word_hash(b""), START, *map(word_hash, common)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            """Rows are ``(rid, doc_id, flag, words, begins, ends)``: words after the two before a run."""
            numbered = pa.concat_arrays([first_words, *(r[3] for r in rows)]).dictionary_encode()
            begins, ends, held = (np.array(x, np.int64) for x in ([r[4] for r in rows], [r[5] for r in rows], [len(r[3]) for r in rows]))
            lens = 2 * begins + held + ends
            ids = np.zeros(lens.sum(), np.uint32)
            starts = np.cumsum(lens) - lens
            at = starts[begins == 1]
            ids[at] = ids[at + 1] = 1
            ids[np.arange(held.sum()) + np.repeat(starts + 2 * begins - (np.cumsum(held) - held), held)] = numbered.indices.to_numpy()[len(common) :] + 2
            rare_words = numbered.dictionary[len(common) :].view(pa.binary()).to_pylist()
            rare_hashes = np.array([word_hash(w) for w in rare_words], np.uint64)
            rising = np.argsort(rare_hashes)
            number = np.arange(slots + len(rising), dtype=np.uint32)
            number[slots + rising] = np.arange(slots, slots + len(rising), dtype=np.uint32)
            ids, hashes = number[ids], np.concatenate([common_hashes, rare_hashes[rising]])  # words not in the list go by rising hash
            place = np.arange(len(hashes), dtype=np.uint32)
            inside = np.ones(len(ids), bool)
            inside[starts] = inside[starts + 1] = False
            at = np.flatnonzero(inside)
            u, v, w = ids[at - 1], ids[at - 2], ids[at]
            shard = ((hashes >> np.uint64(20)) % np.uint64(len(shards))).astype(np.uint16 if len(shards) <= 1 << 16 else np.int64)[u]
            salted = np.flatnonzero(np.isin(hashes, hot)[u])
            shard[salted] = _mix(hashes[v[salted]] ^ hashes[u[salted]]) % np.uint64(len(shards))
            doc = np.repeat(np.arange(len(rows), dtype=np.uint32), lens - 2)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(len(shards) + 1))
            heads = [np.array(c, np.int64) for c in ([r[0] for r in rows], [r[1] or 0 for r in rows], [r[2] | (r[1] is None) << 1 for r in rows])]
            found = [k for k in range(len(shards)) if edges[k + 1] > edges[k]]
            blobs = []
            for k in found:
                part = order[edges[k] : edges[k + 1]]
                d, three, cnt = doc[part], np.stack([u[part], v[part], w[part]]), np.ones(len(part), np.uint8)
                if len(part) * 4 > len(order):  # much of the texts has few words before: count repeats first
                    rows4, cnt = np.unique(np.concatenate([[d], three]), axis=1, return_counts=True)
                    d, three = rows4[0], rows4[1:]
                new = np.concatenate([[True], d[1:] != d[:-1]])
                here = np.zeros(len(hashes), bool)
                here[three] = True
                used = np.flatnonzero(here[slots:]) + slots
                place[used] = np.arange(slots, slots + len(used), dtype=np.uint32)
                three = place[three]
                own = np.zeros(slots + len(used), bool)
                own[three[0]] = True
                before = np.flatnonzero(own)
                three[0] = (np.cumsum(own, dtype=np.uint32) - np.uint32(1))[three[0]]
                docs = d[new]
                blobs.append(squeeze([np.diff(heads[0][docs], prepend=0), heads[1][docs], small(heads[2][docs]), steps(hashes[used]), planes(before), *(planes(x) for x in three), planes(np.bincount(np.cumsum(new) - 1)), small(cnt)]))
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array(shards[found], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        rows, size = [], 0
        for b in batches:
            words, edges = words_of(b.column(3))
            chars = pc.fill_null(pc.binary_length(b.column(3)), 0).to_pylist()
            for k, (rid, doc_id, flag) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                own = words.slice(edges[k], edges[k + 1] - edges[k])
                n = len(own) + 1  # with the end
                for lo in range(0, n, CHUNK):
                    hi = min(lo + CHUNK, n)
                    rows.append((rid, doc_id, flag, own.slice(max(lo - 2, 0), min(hi, n - 1) - max(lo - 2, 0)), lo == 0, hi == n))
                    size += chars[k] * (hi - lo) // n + 1
                    if size > FLUSH:
                        yield flush(rows)
                        rows, size = [], 0
        if rows:
            yield flush(rows)

    return run


# --- seating ----------------------------------------------------------------------------------

_STIRLING: dict[float, np.ndarray] = {}


def log_stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of customers and tables, up to ``EXACT``."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0.0
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], s[c, t] + stay)
        _STIRLING[d] = s
    return _STIRLING[d]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series, seven places on for small ones."""
    x = np.asarray(x, np.float64)
    y, low = x, 0.0
    if x.size and x.min() < 9:
        y = x + 7
        low = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, theta: float, d: float, key: np.ndarray, step: int) -> np.ndarray:
    """Table counts of dishes with up to ``EXACT`` customers, given others' tables and the parent's ``p``: exact draws."""
    t = np.minimum(c, 1).astype(np.int64)
    logs, u = log_stirling(d), uniforms(key, step)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for n in range(2, EXACT + 1):
        group = order[edges[n - 2] : edges[n - 1]]
        for rows in np.array_split(group, len(group) * n // 1_000_000 + 1):
            if len(rows):
                j = np.arange(n)
                w = np.cumsum(np.log((theta + d * (others[rows][:, None] + j)) * p[rows][:, None]), axis=1) + logs[n, 1 : n + 1]
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                t[rows] = 1 + (w < (u[rows] * w[:, -1])[:, None]).sum(axis=1)
    return t


def crowd(t: int, start: int, c: int, others, p, theta: float, d: float, key, step: int) -> np.ndarray:
    """Where the tables of one dish are opened while its customers come, if that happens often.

    The tables before each customer of a run are settled by repetition: every round is right a customer further at least.
    """
    ends = []
    for n in range(start, c, 20_000):
        at = np.arange(n, min(c, n + 20_000))
        u, tables = uniforms(_mix(at.astype(np.uint64) ^ key), step), np.full(len(at), t)
        while True:
            a = (theta + d * (others + tables)) * p
            opened = u * (a + at - d * tables) < a
            now = t + np.cumsum(opened) - opened
            if (now == tables).all():
                break
            tables = now
        ends.append(at[opened] + 1)
        t += int(opened.sum())
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def arrive(row, t, start, c, others, p, theta: float, d: float, key, step: int) -> np.ndarray:
    """Customers of dishes come one by one, from ``start`` customers at ``t`` tables up to ``c``.

    Returns spells ``(row, tables, from, to)``: a spell's last customer opens a table, but the last spell's.
    """
    out, n = [], 0
    row, t, start, c, others, p, key = (np.asarray(x) for x in (row, t, start, c, others, p, key))
    t, start = t.astype(np.float64), start.astype(np.float64)
    while len(row):
        n += 1
        if n > 12:  # dishes with frequent new tables: customer by customer
            often = c - start < 2000 * t
            for r, t0, s0, c0, o, q, k in zip(*(x[often] for x in (row, t, start, c, others, p, key))):
                ends = crowd(int(t0), int(s0), int(c0), o, q, theta, d, k, step * 1_000_003)
                out.append(np.stack([np.full(len(ends) + 1, r), t0 + np.arange(len(ends) + 1), np.concatenate([[s0], ends]), np.concatenate([ends, [c0]])]))
            row, t, start, c, others, p, key = (x[~often] for x in (row, t, start, c, others, p, key))
        a, x, u = (theta + d * (others + t)) * p, start - d * t, np.log(uniforms(key, step * 1_000_003 + n))
        base = log_gamma(x + a) - log_gamma(x)
        none = lambda k: base + log_gamma(x + k) - log_gamma(x + k + a)  # noqa: E731  log chance of no new table among k customers
        last = none(c - start) > u
        out.append(np.stack([row, t, start, c])[:, last])
        row, t, start, c, others, p, key, a, x, u, base = (y[~last] for y in (row, t, start, c, others, p, key, a, x, u, base))
        lo, hi = np.zeros(len(row)), c - start
        while (wide := hi - lo > 1).any():
            mid = np.where(wide, np.floor((lo + hi) / 2), hi)
            past = none(mid) <= u
            hi, lo = np.where(wide & past, mid, hi), np.where(wide & ~past, mid, lo)
        end = start + hi
        out.append(np.stack([row, t, start, end]))
        out.append(np.stack([row, t + 1, c, c])[:, end == c])
        go = end < c
        row, t, start, c, others, p, key = row[go], t[go] + 1, end[go], c[go], others[go], p[go], key[go]
    return np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((4, 0), np.int64)


class Seats:
    """Table counts of the dishes of restaurants, and the spells of dishes with over ``EXACT`` customers."""

    def __init__(self, t: np.ndarray, spells: np.ndarray | None = None):
        self.t = t
        self.spells = np.zeros((4, 0), np.int64) if spells is None else spells

    def redo(self, rows, c, others, p, theta: float, d: float, key, step: int) -> None:
        """The dishes ``rows`` seated anew; the other arrays are of the rows only."""
        few = c <= EXACT
        t = self.t.copy()
        t[rows[few]] = seat(c[few], others[few], p[few], theta, d, key[few], step)
        gone = np.zeros(len(t), bool)
        gone[rows] = True
        old = self.spells[:, gone[self.spells[0]]]
        kept = [self.spells[:, ~gone[self.spells[0]]]]
        many = np.flatnonzero(~few)
        if len(many):
            r, place = rows[many], np.full(len(t), -1, np.int64)
            place[r] = np.arange(len(many))
            c, others, p, key = c[many], others[many], p[many], key[many]
            old = old[:, place[old[0]] >= 0]
            at = place[old[0]]
            old, at = old[:, old[2] <= c[at]], at[old[2] <= c[at]]  # customers that left since
            old[3] = np.minimum(old[3], c[at])
            # customers that came since, on from the last spell
            tail = np.zeros(len(many), np.int64)
            np.maximum.at(tail, at, old[1])
            ends = np.full(len(many), EXACT, np.int64)
            np.maximum.at(ends, at, old[3])
            fresh = tail == 0
            first = lambda k: seat(np.full(len(many), EXACT), others, p, theta, d, key, step + k)
            tail = np.where(fresh, first(200), tail)
            more = (ends < c) | fresh
            grown = arrive(np.flatnonzero(more), tail[more], ends[more], c[more], others[more], p[more], theta, d, key[more], step + 400)
            path = np.concatenate([np.stack([at, *old[1:]]), grown], axis=1)
            path = self._joined(path)
            new = self._joined(arrive(np.arange(len(many)), first(600), np.full(len(many), EXACT), c, others, p, theta, d, key, step + 800))

            def weight(s):
                a, x = (theta + d * (others[s[0]] + s[1])) * p[s[0]], -d * s[1]
                return np.bincount(s[0], log_gamma(s[3] + x + a) - log_gamma(s[2] + x + a), len(many))

            take = np.log(uniforms(key, step + 1200)) < weight(new) - weight(path)
            chosen = np.concatenate([new[:, take[new[0]]], path[:, ~take[path[0]]]], axis=1)
            top = np.zeros(len(many), np.int64)
            np.maximum.at(top, chosen[0], chosen[1])
            t[r] = top
            kept.append(np.stack([r[chosen[0]], *chosen[1:]]))
        self.t, self.spells = t, np.concatenate(kept, axis=1)

    @staticmethod
    def _joined(s: np.ndarray) -> np.ndarray:
        """Spells of one dish at the same number of tables as one."""
        order = np.lexsort((s[2], s[1], s[0]))
        s = s[:, order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(s[0]) != 0) | (np.diff(s[1]) != 0)])) if s.shape[1] else np.zeros(0, np.int64)
        return np.stack([s[0][first], s[1][first], s[2][first], np.maximum.reduceat(s[3], first)]) if len(first) else s

    def likelihood(self, c: np.ndarray) -> np.ndarray:
        """Log likelihood of the dishes' seating by discount, but for the terms of whole restaurants."""
        out = np.zeros(len(DISCOUNTS))
        few = (c >= 2) & (c <= EXACT)
        pairs, n = np.unique(c[few] * (EXACT + 1) + self.t[few], return_counts=True)
        r, t, lo, hi = self.spells
        top = np.zeros(len(c), np.int64)
        np.maximum.at(top, r, t)
        hi = hi - (t < top[r])  # the last customer of the other spells opened a table
        start = t[lo == EXACT]
        for k, d in enumerate(DISCOUNTS):
            out[k] = (n * log_stirling(d).ravel()[pairs]).sum() + log_stirling(d)[EXACT, start].sum() + (log_gamma(hi - d * t) - log_gamma(lo - d * t)).sum()
        return out


def restaurants(tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """Log likelihood of restaurants' totals, by discount and strength."""
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    ts, n = np.unique(tables[tables > 0], return_counts=True)
    cs, m = np.unique(customers[customers > 0], return_counts=True)
    for j, s in enumerate(STRENGTHS):
        c = (m * (log_gamma(s + cs) - log_gamma(np.array([s])))).sum()
        for i, d in enumerate(DISCOUNTS):
            out[i, j] = (n * (ts * np.log(d) + log_gamma(s / d + ts) - log_gamma(np.array([s / d])))).sum() - c
    return out


def predictive(c, t, tables, customers, up, theta, d):
    """A restaurant's chance of dishes with ``c`` customers at ``t`` tables, given the parent's ``up``."""
    return (c - d * t + (theta + d * tables) * up) / (theta + customers)


# --- a shard ----------------------------------------------------------------------------------


class Shard:
    """All tokens after the shard's words, and the seating of its training tokens."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray, common: np.ndarray):
        cols = [expand(b) for b in sorted(blobs)]
        self.rids, self.ids, self.flags = np.concatenate([np.cumsum(x[0]) for x in cols]), np.concatenate([x[1] for x in cols]), np.concatenate([x[2] for x in cols])
        at = np.cumsum([0] + [len(x[0]) for x in cols])
        self.doc = np.concatenate([np.repeat(np.arange(len(x[0]), dtype=np.int32) + lo, numbers_of(x[8])) for x, lo in zip(cols, at)])
        self.cnt = np.concatenate([x[9].astype(np.int32) for x in cols])
        # words of all blocks: the common ones that are here, then the others by hash
        rare = [hashes_of(x[3]) for x in cols]
        others, local = np.unique(np.concatenate(rare), return_inverse=True)
        local, lo = local.astype(np.int32) + np.int32(len(common)), np.cumsum([0] + [len(x) for x in rare])
        number = [np.concatenate([np.arange(len(common), dtype=np.int32), local[i:j]]) for i, j in zip(lo, lo[1:])]
        u = np.concatenate([n[numbers_of(x[4])][numbers_of(x[5])] for n, x in zip(number, cols)])
        v, w = (np.concatenate([n[numbers_of(x[k])] for n, x in zip(number, cols)]) for k in (6, 7))
        here = np.zeros(len(common) + len(others), bool)
        for ids in (u, v, w):
            here[ids] = True
        place = np.cumsum(here, dtype=np.int32) - np.int32(1)
        u, v, w = place[u], place[v], place[w]
        self.words = np.concatenate([common, others])[here]
        n = len(self.words)
        del cols, local, number, rare
        if n < 2_000_000:
            both = u.astype(np.int64)
            for x in (v, w):
                both *= n
                both += x
            del u, v, w, x
            types, self.row3 = np.unique(both, return_inverse=True)
            w3, both = types % n, types // n
            new = np.concatenate([[True], both[1:] != both[:-1]])
            pairs, self.x3 = both[new], (np.cumsum(new) - 1).astype(np.int32)
        else:
            pairs, x = np.unique(u.astype(np.int64) * n + v, return_inverse=True)
            types, self.row3 = np.unique(x * n + w, return_inverse=True)
            self.x3, w3 = (types // n).astype(np.int32), types % n
            del u, v
        self.row3 = self.row3.astype(np.int32)
        both, row2 = np.unique(pairs[self.x3] // n * n + w3, return_inverse=True)
        self.row2, self.u2, self.w2 = row2.astype(np.int32), both // n, both % n
        self.c3 = np.bincount(self.row3, self.cnt * (self.flags[self.doc] & 1), len(types)).astype(np.int64)
        self.pairs, self.n = len(pairs), n
        self.customers3 = np.bincount(self.x3, self.c3, self.pairs)
        self.shared = np.isin(self.words, hot)[self.u2]  # rows of one-word restaurants that lie in buckets
        self.raw = np.bincount(self.w2[row2], self.c3, n).astype(np.int64)
        self.key2 = _mix(self.words[self.u2] ^ _mix(self.words[self.w2]))
        self.multi = np.flatnonzero(self.c3 > 1)
        once = self.c3 == 1  # these always have one table
        self.once2, self.once3 = np.bincount(self.row2[once], minlength=len(both)), np.bincount(self.x3[once], minlength=len(pairs))
        self.key3 = _mix(self.key2[row2[self.multi]] ^ _mix(self.words[pairs[self.x3[self.multi]] % n]))
        self.s3, self.s2 = Seats(np.minimum(self.c3, 1)), Seats(np.zeros(len(both), np.int64))
        self.s2.t = np.where(self.shared, 0, np.minimum(self.below(), 1))

    def below(self) -> np.ndarray:
        """Customers that this shard's word pairs send to the one-word restaurants."""
        return self.once2 + np.bincount(self.row2[self.multi], self.s3.t[self.multi], len(self.u2)).astype(np.int64)

    def sent(self) -> np.ndarray:
        """Customers that this shard's own one-word restaurants send to the restaurant of all words."""
        return np.bincount(self.w2, np.where(self.shared, 0, self.s2.t), self.n).astype(np.int64)

    # state between jobs
    def pack_state(self) -> bytes:
        return squeeze([small(self.s3.t[self.multi]), *self.s3.spells, small(self.s2.t), *self.s2.spells])

    def load_state(self, blob: bytes) -> None:
        a = expand(blob)
        self.s3.t[self.multi] = a[0]
        self.s3.spells, self.s2 = np.stack(a[1:5]), Seats(a[5].astype(np.int64), np.stack(a[6:10]))

    # exchange
    def orders(self, buckets: int):
        """Row numbers of words and of shared rows by bucket; alike whenever the shard is built."""
        word, rows = self.words % np.uint64(buckets), np.flatnonzero(self.shared)
        for b in range(buckets):
            mine = np.flatnonzero(word == b)
            mine = mine[np.argsort(self.words[mine])]
            if len(mine):
                yield b, mine, rows[word[self.w2[rows]] == b]

    def to_buckets(self, me: int, buckets: int):
        below, sent, place = self.below(), self.sent(), np.zeros(self.n, np.int64)
        for b, mine, rows in self.orders(buckets):
            place[mine] = np.arange(len(mine))
            local = place[self.w2[rows]]
            yield TO_BUCKET, b, me, squeeze([steps(self.words[mine]), small(sent[mine]), small(self.raw[mine]), self.words[self.u2[rows]], small(local), small(below[rows])]), None

    def from_buckets(self, rows: dict[int, bytes], buckets: int, totals: dict) -> None:
        """Readings of the restaurant of all words and of shared rows, as of the exchange."""
        self.c1, self.t1, self.count = (np.zeros(self.n, np.int64) for _ in range(3))
        c2, t2 = np.zeros(len(self.u2), np.int64), np.zeros(len(self.u2), np.int64)
        for b, mine, shared in self.orders(buckets):
            c1, t1, raw, c, t = expand(rows[b])
            self.c1[mine], self.t1[mine], self.count[mine], c2[shared], t2[shared] = c1, t1, raw, c, t
        self.far2 = np.where(self.shared, c2 - self.below(), 0)  # customers from other shards
        self.far1 = self.c1 - self.sent()
        self.s2.t = np.where(self.shared, t2, self.s2.t)
        self.totals = totals
        # totals of shared restaurants: others' part stays
        at = {int(w): i for i, w in enumerate(self.words)}
        self.far_customers, self.far_tables = np.zeros(self.n), np.zeros(self.n)
        here = np.bincount(self.u2, np.where(self.shared, self.below(), 0), self.n)
        mine = np.bincount(self.u2, np.where(self.shared, t2, 0), self.n)
        for w, (tables, customers) in totals["contexts"].items():
            if w in at:
                self.far_tables[at[w]], self.far_customers[at[w]] = tables - mine[at[w]], customers - here[at[w]]

    # chances
    def root(self, leave=0, rows=slice(None)) -> np.ndarray:
        """The chance of words in the restaurant of all words, ``leave`` customers gone."""
        h = self.totals
        c = np.maximum(self.far1[rows] + self._sent[rows] - leave, 0)
        t = np.minimum(self.t1[rows], c)
        gone = self.t1[rows] - t
        return predictive(c, t, h["tables1"] - gone, h["customers1"] + self._moved - leave, 1 / (h["vocabulary"] + 1), h["theta1"], h["d1"])

    def refresh(self, lowest: bool = True) -> None:
        """Totals of all levels, or all but the ``lowest``, from the present seating."""
        if lowest:
            below = self.below()
            self._c2 = self.far2 + below
            self.s2.t = np.clip(self.s2.t, np.minimum(self._c2, 1), self._c2)
            self._tables3 = self.once3 + np.bincount(self.x3[self.multi], self.s3.t[self.multi], self.pairs)
            self._customers2 = np.bincount(self.u2, below, self.n) + self.far_customers
        self._sent = self.sent()
        self._moved = int((self.far1 + self._sent - self.c1).sum())
        self._tables2 = np.bincount(self.u2, self.s2.t, self.n) + self.far_tables

    def sweep(self, step: int) -> None:
        """Every dish of the shard's restaurants seated anew, the word pairs' first."""
        h = self.totals
        self.refresh()
        colour = self.key3 % np.uint64(COLOURS)
        for k in range(COLOURS):
            at = np.flatnonzero(colour == k)
            i = self.multi[at]
            j, t = self.row2[i], self.s3.t[i]
            c = self._c2[j] - t
            tables = np.minimum(self.s2.t[j], c)
            u = self.u2[j]
            up = predictive(c, tables, self._tables2[u] - (self.s2.t[j] - tables), self._customers2[u] - t, self.root(self.s2.t[j] - tables, self.w2[j]), h["theta2"], h["d2"])
            self.s3.redo(i, self.c3[i], self._tables3[self.x3[i]] - t, up, h["theta3"], h["d3"], self.key3[at], 10_000 * step + k)
            self.refresh()
        colour = self.key2 % np.uint64(COLOURS)
        for k in range(COLOURS):
            j = np.flatnonzero((colour == k) & (self._c2 > 1) & ~self.shared)
            t, u = self.s2.t[j], self.u2[j]
            self.s2.redo(j, self._c2[j], self._tables2[u] - t, self.root(t, self.w2[j]), h["theta2"], h["d2"], self.key2[j], 10_000 * step + 5000 + k)
            self.refresh(lowest=False)

    def chances(self) -> np.ndarray:
        """The model's chance of every (pair, word) under the present seating; sums to one over words."""
        h = self.totals
        root = predictive(self.c1, self.t1, h["tables1"], h["customers1"], 1 / (h["vocabulary"] + 1), h["theta1"], h["d1"])
        up = predictive(self._c2, self.s2.t, self._tables2[self.u2], self._customers2[self.u2], root[self.w2], h["theta2"], h["d2"])
        return predictive(self.c3, self.s3.t, self._tables3[self.x3], self.customers3[self.x3], up[self.row2], h["theta3"], h["d3"])

    def numbers(self) -> np.ndarray:
        """What the driver adds up: counts of ones and twos, then likelihoods of both levels."""
        c2 = np.where(self.shared, 0, self.below())
        ones = [(self.c3 == 1).sum(), (self.c3 == 2).sum(), (c2 == 1).sum(), (c2 == 2).sum()]
        own = np.zeros(self.n, bool)
        own[self.u2[~self.shared]] = True
        t2 = np.bincount(self.u2, np.where(self.shared, 0, self.s2.t), self.n)
        three = restaurants(np.bincount(self.x3, self.s3.t, self.pairs), self.customers3) + self.s3.likelihood(self.c3)[:, None]
        two = restaurants(t2[own], np.bincount(self.u2, c2, self.n)[own]) + self._only(self.s2, ~self.shared).likelihood(c2)[:, None]
        return np.concatenate([ones, np.zeros(4), three.ravel(), two.ravel(), np.zeros(two.size)])

    @staticmethod
    def _only(s: Seats, rows: np.ndarray) -> Seats:
        return Seats(np.where(rows, s.t, 0), s.spells[:, rows[s.spells[0]]])


# --- a bucket ---------------------------------------------------------------------------------


def bucket(senders: list[int], blobs: list[bytes], h: dict):
    """Adds up the shards' customers, seats shared rows and the restaurant of all words, answers each shard."""
    cols = [[hashes_of(x[0]), *x[1:]] for x in map(expand, blobs)]
    words, at = np.unique(np.concatenate([x[0] for x in cols]), return_inverse=True)
    lo = np.cumsum([0] + [len(x[0]) for x in cols])
    add = lambda k: np.bincount(at, np.concatenate([x[k] for x in cols]), len(words)).astype(np.int64)
    c1, raw = add(1), add(2)
    uw = np.concatenate([np.stack([x[3], words[at[a:b]][x[4]]]) for x, a, b in zip(cols, lo, lo[1:])], axis=1)
    order = np.lexsort(uw)
    first = np.concatenate([[True], (np.diff(uw[:, order].astype(np.int64)) != 0).any(axis=0)]) if len(order) else np.zeros(0, bool)
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(first) - 1
    u, w = uw[:, order][:, first]
    w = np.searchsorted(words, w)
    c2 = np.bincount(row, np.concatenate([x[5] for x in cols]), len(u)).astype(np.int64)
    s2, s1 = Seats(np.minimum(c2, 1)), Seats(np.zeros(len(words), np.int64))
    own = c1
    c1 = own + np.bincount(w, s2.t, len(words)).astype(np.int64)
    s1.t = np.minimum(c1, 1)
    if "tables1" in h:
        tables = np.array([h["contexts"].get(int(x), (0, 0))[0] for x in u], np.int64)
        key, rows = _mix(u ^ _mix(words[w])), np.flatnonzero(c2 > 1)
        for k in range(3):
            many = np.flatnonzero(c1 > 1)
            s1.redo(many, c1[many], np.maximum(h["tables1"] - s1.t[many], 0), np.full(len(many), 1 / (h["vocabulary"] + 1)), h["theta1"], h["d1"], words[many], 10 * h["step"] + k)
            if k < 2 and len(rows):
                left = c1[w] - s2.t  # customers of the word without the row's own
                up = predictive(left, np.minimum(s1.t[w], left), h["tables1"], h["customers1"] - s2.t, 1 / (h["vocabulary"] + 1), h["theta1"], h["d1"])
                s2.redo(rows, c2[rows], np.maximum(tables - s2.t, 0)[rows], up[rows], h["theta2"], h["d2"], key[rows], 10 * h["step"] + k)
                c1 = own + np.bincount(w, s2.t, len(words)).astype(np.int64)
                s1.t = np.minimum(s1.t, c1)
    places = np.cumsum([0] + [len(x[5]) for x in cols])
    for k, sender in enumerate(senders):
        r = slice(lo[k], lo[k + 1])
        mine = row[places[k] : places[k + 1]]
        yield TO_SHARD, sender, h["bucket"], squeeze([small(c1[at[r]]), small(s1.t[at[r]]), small(raw[at[r]]), small(c2[mine]), small(s2.t[mine])]), None
    head = [0, 0, (c2 == 1).sum(), (c2 == 2).sum(), raw.sum(), (raw > 0).sum(), c1.sum(), s1.t.sum()]
    wide = len(STRENGTHS)
    dishes = lambda s, c: np.repeat(s.likelihood(c), wide)  # noqa: E731  a discount's sum for every strength
    yield NUMBERS, 0, 0, None, np.concatenate([head, np.zeros(len(DISCOUNTS) * wide), dishes(s2, c2), dishes(s1, c1)])
    contexts, of = np.unique(u, return_inverse=True)
    for x, t, c in zip(contexts.astype(np.int64).tolist(), np.bincount(of, s2.t), np.bincount(of, c2)):
        yield CONTEXT, x, 0, None, np.array([t, c], float)


# --- jobs -------------------------------------------------------------------------------------


def _batch(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=["kind", "key", "sender", "blob", "nums"])


def _frequent_words(docs: DataFrame, chars: int, shards: int) -> tuple[np.ndarray, list[bytes]]:
    """Hashes of words that may hold over a quarter of a shard (at most ``4 * shards``), and the ``COMMON`` most frequent words.

    From a sample of about ``SAMPLE_CHARS``. Only the placing of work and the size of blocks depend on them.
    """
    part = docs.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, chars // SAMPLE_CHARS))) == 0).select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w"))
    top = part.where("w != '' and length(w) <= 40").groupBy("w").count().orderBy(F.desc("count"), "w").limit(COMMON).collect()
    least = max(sum(r["count"] for r in top) / (4 * shards), 100)
    hot = [word_hash(r["w"].encode()) for r in top if r["count"] > least]
    return np.unique(np.array([*hot, START], np.uint64)), [r["w"].encode() for r in top]


def _reading(flow: DataFrame, h: dict, step: int) -> dict:
    """Totals that all need, and the next discounts and strengths, from the numbers of shards and buckets."""
    sums = flow.where(F.col("kind").isin(NUMBERS, CONTEXT)).select("kind", "key", F.posexplode("nums")).groupBy("kind", "key", "pos").agg(F.sum("col").alias("n")).collect()
    numbers = np.zeros(8 + 3 * len(DISCOUNTS) * len(STRENGTHS))
    contexts: dict[int, list] = {}
    for r in sums:
        if r["kind"] == NUMBERS:
            numbers[r["pos"]] = r["n"]
        else:
            contexts.setdefault(r["key"] % (1 << 64), [0, 0])[r["pos"]] = int(r["n"])
    three, two, one = numbers[8:].reshape(3, len(DISCOUNTS), len(STRENGTHS))
    totals = np.array([contexts[k] for k in contexts], np.int64).reshape(-1, 2)
    two = two + restaurants(totals[:, 0], totals[:, 1])
    out = {"contexts": contexts, "tokens": int(numbers[4]), "vocabulary": int(numbers[5]), "customers1": int(numbers[6]), "tables1": int(numbers[7]), "step": step}
    one = one + restaurants(np.array([out["tables1"]]), np.array([out["customers1"]]))
    if "d3" not in h:  # no seating yet: from the counts of ones and twos
        nearest = lambda a, b: min(DISCOUNTS, key=lambda d: abs(d - (a / (a + 2 * b) if a else 0.5)))
        return out | {"d3": nearest(*numbers[:2]), "d2": nearest(*numbers[2:4]), "d1": 0.5, "theta3": 1.0, "theta2": 1.0, "theta1": 1.0}
    for level, grid in ((3, three), (2, two), (1, one)):
        p = np.exp(grid - grid.max()).ravel()
        i = int(np.searchsorted(np.cumsum(p), np.random.default_rng(100 * step + level).random() * p.sum()))
        i, j = divmod(min(i, p.size - 1), len(STRENGTHS))
        out |= {f"d{level}": DISCOUNTS[i], f"theta{level}": STRENGTHS[j]}
    return out


@contextmanager
def _planned_once(spark: SparkSession):
    """No adaptive plans inside, so that what is cut there keeps its known partitioning."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _settle(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, cut off from what made it; Spark then deletes the files of the shuffles before, in its own time, which is waited for.

    Nobody may hold the frame that is cut, callers' arguments included: its shuffle files stay as long.
    """
    done = cut(make())
    for _ in range(2):  # after one collection the files were still there
        time.sleep(1)  # the session's listeners let go of the query
        gc.collect()
        done.sparkSession._jvm.System.gc()
    time.sleep(1)
    return done


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row, learning from rows where ``learn``."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), learn.alias("learn"), F.col("text").cast("string"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(LEAST_SHARDS, chars // SHARD_CHARS + 1)
    buckets = max(8, n // 4)
    hot, common = _frequent_words(rows, chars, n)
    hashes = np.array([word_hash(b""), START, *map(word_hash, common)], np.uint64)
    places = spark.range(40 * n).select(F.col("id").alias("k"), F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    shards = np.array([r["k"] for r in places.groupBy("p").agg(F.min("k").alias("k")).collect()])  # one key a partition
    def counted(part: int) -> DataFrame:
        some = rows.where(F.pmod("rid", F.lit(PARTS)) == part)
        blobs = some.select("rid", "doc_id", F.coalesce(F.col("learn"), F.lit(False)).cast("int"), F.col("text").cast("binary")).mapInArrow(_count(shards, hot, common), "shard long, blob binary")
        return blobs.repartition(n, "shard")

    with _planned_once(spark):
        blocks = reduce(DataFrame.unionByName, [_settle(lambda: counted(k)) for k in range(PARTS)])  # keeps the partitioning of its parts

    def meet(flow: DataFrame, h: dict) -> DataFrame:
        def run(key, part):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("kind", "sender", "blob", "nums"))))
            got = sorted((sender, blob) for kind, sender, blob, _ in rows if kind == TO_BUCKET)
            through = [(NUMBERS, 0, 0, None, nums) for kind, _, _, nums in rows if kind == NUMBERS]
            return _batch([*through, *(bucket([s for s, _ in got], [b for _, b in got], h | {"bucket": key[0].as_py()}) if got else ())])

        return flow.where(F.col("kind").isin(TO_BUCKET, NUMBERS)).groupBy("key").applyInArrow(run, FLOW)

    def begin(key, part):
        me, s = key[0].as_py(), Shard(part.column("blob").to_pylist(), hot, hashes)
        return _batch([*s.to_buckets(me, buckets), (NUMBERS, me % buckets, 0, None, s.numbers())])

    def load(me: int, blobs: pa.Table, letters: pa.Table, h: dict) -> Shard:
        s = Shard(blobs.column("blob").to_pylist(), hot, hashes)
        rows = list(zip(*(letters.column(c).to_pylist() for c in ("kind", "sender", "blob"))))
        for kind, _, blob in rows:
            if kind == STATE:
                s.load_state(blob)
        s.from_buckets({sender: blob for kind, sender, blob in rows if kind == TO_SHARD}, buckets, h)
        return s

    def burn(h: dict):
        def run(key, blobs, letters):
            me = key[0].as_py()
            s = load(me, blobs, letters, h)
            for k in range(BURN_IN):
                s.sweep(k + 1)
            return _batch([*s.to_buckets(me, buckets), (STATE, me, 0, s.pack_state(), None), (NUMBERS, me % buckets, 0, None, s.numbers())])

        return run

    def finish(h: dict):
        def run(key, blobs, letters):
            s = load(key[0].as_py(), blobs, letters, h)
            p = np.zeros(len(s.c3))
            for k in range(SAMPLES):
                s.sweep(BURN_IN + k + 1)
                p += s.chances() / SAMPLES
            w = s.w2[s.row2]
            base = np.log10((s.count + 0.1) / (h["tokens"] + 0.1 * (h["vocabulary"] + 1)))[w]
            add = lambda x: np.bincount(s.doc, s.cnt * x[s.row3], len(s.rids))
            ids = pa.array(s.ids, pa.int64(), mask=s.flags & 2 > 0)
            cols = [pa.array(s.rids), ids, pa.array(np.bincount(s.doc, s.cnt, len(s.rids)).astype(np.int64)), pa.array(add((s.count > 0)[w]).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
            return pa.table(cols, names=["rid", "doc_id", "n_tokens", "n_known", "base_score", "score"])

        return run

    def together(letters: DataFrame):
        return blocks.groupBy("shard").cogroup(letters.where(F.col("kind").isin(TO_SHARD, STATE)).withColumnRenamed("key", "shard").groupBy("shard"))

    sent = blocks.groupBy("shard").applyInArrow(begin, FLOW)
    back = _settle(lambda: meet(sent, {"step": 1}))
    h = _reading(back, {}, 2)
    sent = _settle(lambda: together(back).applyInArrow(burn(h), FLOW))
    back = _settle(lambda: meet(sent, h))
    h = _reading(back, h, 3)
    sums = together(sent.unionByName(back)).applyInArrow(finish(h), OUT).groupBy("rid", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return cut(sums.select("doc_id", "n_tokens", "n_known", F.lit(h["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"))
