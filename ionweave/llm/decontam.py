"""Benchmark decontamination through the CGK embedding.

The CGK random walk maps word sequences so that a small edit distance becomes a small Hamming
distance: it reads a window word by word, emits the current word at every step and moves on when a
random bit of (walk, step, word), taken from a hash, says so. Items of up to ``2 * PIECE - 1`` words are
embedded whole, in windows of their own size; the distortion of a walk grows with the square of its edits, so a
longer item is cut into pieces of ``PIECE`` to twice as many words that cover it, and of its edits some piece has
no more than its share. Pieces and document windows of the same size take the same walks; bit-sampling LSH compares
``SAMPLED`` random coordinates in each of ``TABLES`` tables a walk, and every collision is verified by the exact edit
distance of the whole item to the best-matching run of words around it (bit-parallel, no approximation).
The walks of a size are as many as a piece with its share of edits needs to be met with a chance of ``TARGET``, and of
``EACH`` for every kind of edits alone (``KINDS``: spread, in the first half, only deletions, only insertions, only
substitutions, every second word).

Windows are taken at every word. Those with too few of the items' word pairs are passed over first: an
edit breaks two pairs at most (the q-gram lemma), so this loses nothing. Items go in id order into blocks of at most
``BLOCK`` items and ``BLOCK_WORDS`` words (a longer item is a block), which are broadcast; an index has some hundred bytes
a piece, whatever the vocabulary. Documents are read once for all blocks, and a task holds ``HELD`` blocks at a time.

Words are lower-cased and lose edge punctuation. Null or empty texts match nothing, items without a
word are skipped, repeated items and repeated documents are reported each, other columns are ignored, and empty
tables give no match.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed, as a share of the item's words.
EDITS = 0.2
#: Least recall at that limit: over all kinds of edits, and of each kind.
TARGET, EACH = 0.998, 0.985
KINDS = ("spread", "front", "delete", "insert", "replace", "second", "first")
PIECE, LEAST, TABLES, SAMPLED = 12, 6, 3, 3
BLOCK, BLOCK_WORDS, HELD = 2000, 400_000, 4
HITS = "doc_id long, item_id long, distance int, n_item_words int, similarity double"
EDGES = string.punctuation + "«»“”„‘’…–—¡¿"


def norm(token: str) -> str:
    return token.lower().strip(EDGES)


def norms(tokens: pa.StringArray) -> pa.StringArray:
    """``norm`` of each token; only those beyond ASCII go one by one."""
    plain, odd = pc.ascii_trim(pc.ascii_lower(tokens), characters=string.punctuation), pc.invert(pc.string_is_ascii(tokens))
    return pc.replace_with_mask(plain, odd, pa.array([norm(t) for t in tokens.filter(odd).to_pylist()], pa.string()))


class Tokens:
    """Texts as codes of words, for all blocks of items; texts without a token are left out, bare punctuation is dropped."""

    def __init__(self, texts: list[str | None]):
        self.owners, sizes, flat = [], [0], []
        for k, text in enumerate(texts):
            tokens = text.split() if text else []
            if tokens:
                self.owners.append(k)
                flat += tokens
                sizes.append(len(tokens))
        coded = pa.array(flat, pa.string()).dictionary_encode()
        self.forms = norms(coded.dictionary)
        codes, word = coded.indices.to_numpy(), pc.not_equal(self.forms, "").to_numpy(zero_copy_only=False)
        word = word[codes]
        ends = np.concatenate([[0], np.cumsum(word)])[np.cumsum(sizes)]
        codes = codes[word]
        self.texts = [codes[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def as_words(self, vocab: pa.StringArray) -> list[np.ndarray]:
        """The texts as places in a vocabulary, from 1; 0 for words that it lacks."""
        table = pc.fill_null(pc.add(pc.index_in(self.forms, value_set=vocab), 1), 0).to_numpy()
        return [table[c] for c in self.texts]


def edit_distance_within(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Smallest edit distance of a pattern of ``m`` words to any run of ``words`` (bit-parallel)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in words:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64: well-mixed 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(rng: np.random.Generator, size: int) -> tuple[int, list[np.ndarray]]:
    """One walk over windows of ``size`` words: the seed of its moves, and the coordinates that its tables sample."""
    steps = max(SAMPLED, int(1.6 * size))  # at most 64: a hash has the moves of all steps
    return int(rng.integers(1 << 62)), [np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(TABLES)]


def _signatures(words: np.ndarray, starts: np.ndarray, size: int, draws) -> Iterator[np.ndarray]:
    """The LSH signatures of the windows of ``size`` words at ``starts``, table by table."""
    forms = np.arange(int(words.max(initial=0)) + 1, dtype=np.uint64)
    words = words.astype(np.intp)
    coded = words.astype(np.uint64) + np.uint64(1)
    for seed, tables in draws:
        moves = _mix(forms ^ np.uint64(seed))[words]
        at, place = np.zeros(len(starts), np.int64), starts
        sigs = [np.zeros(len(starts), np.uint64) for _ in tables]
        last = max(int(t[-1]) for t in tables)
        for step in range(last + 1):
            if step >= size:  # before, no walk can have left its window
                place = starts + np.minimum(at, size - 1)
            word = None
            for sig, t in zip(sigs, tables):
                if step in t:
                    if word is None:
                        word = coded[place] if step < size else np.where(at < size, coded[place], np.uint64(1))
                    sig *= np.uint64(0x9E3779B97F4A7C15)
                    sig += word
            if step < last:
                at += (moves[place] >> np.uint64(step)).view(np.int64) & 1  # beyond the window only zeros follow
                place = starts + at
        yield from sigs


def _edited(rng: np.random.Generator, size: int, edits: int, kind: str) -> list[int]:
    """The words 1 to ``size`` after ``edits`` random edits of a kind; 0 is a foreign word."""
    w = list(range(1, size + 1))
    if kind in ("first", "second"):
        for p in range(kind == "second", size, 2)[:edits]:
            w[p] = 0
        return w
    for _ in range(edits):
        p = int(rng.integers(max(1, len(w) // (2 if kind == "front" else 1))))
        how = {"delete": 0, "replace": 1, "insert": 2}.get(kind, int(rng.integers(3)))
        w[p : p + 1] = ([], [0], [*w[p : p + 1], 0])[how]
    return w


@lru_cache(maxsize=None)
def walks_needed(size: int, edits: int, target: float, trials: int = 1400) -> int:
    """Walks after which a piece of ``size`` words with ``edits`` edits is met with a chance of ``target``, and ``EACH`` by kind."""
    if not edits:
        return LEAST
    rng = np.random.default_rng(size * 1000 + edits)
    rows = [(_edited(rng, size, edits, KINDS[k % len(KINDS)]) + [0] * size)[:size] for k in range(trials)]
    words = np.array([list(range(1, size + 1)), *rows], np.int32).ravel()
    met, walks = np.zeros(trials, bool), 0
    kinds = np.arange(trials) % len(KINDS)
    while walks < LEAST or (met.mean() < target or np.bincount(kinds, met).min() < EACH * trials / len(KINDS)) and walks < 200:  # edits that leave no word can't be met
        for sig in _signatures(words, np.arange(trials + 1) * size, size, [_draw(rng, size)]):
            met |= sig[1:] == sig[0]
        walks += 1
    return walks


class Index:
    """LSH tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, target: float = TARGET, seed: int = 11):
        self.edits, self.vocab, self.items, rng = edits, {}, [], np.random.default_rng(seed)
        for item_id, text in items:
            words = [w for w in map(norm, (text or "").split()) if w]
            if words:
                self.items.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)))
        self.words = pa.array(list(self.vocab), pa.string())  # a word's place from 1 is its number
        self.longest = max((len(s) for _, s in self.items), default=0)
        self.classes, self.pieces = [], []  # pieces: item, its word that the piece starts with
        sizes: dict[int, list[int]] = {}
        lost: dict[int, int] = {}
        for k, (_, seq) in enumerate(self.items):
            count = max(1, len(seq) // PIECE)
            for j in range(count):
                at, end = len(seq) * j // count, len(seq) * (j + 1) // count
                sizes.setdefault(end - at, []).append(len(self.pieces))
                lost[end - at] = max(lost.get(end - at, 0), int(edits * len(seq)) // count)
                self.pieces.append((k, at))
        for size, own in sorted(sizes.items()):
            draws = [_draw(rng, size) for _ in range(walks_needed(size, lost[size], target))]
            words = np.zeros((len(own), size), np.int32)
            for r, piece in enumerate(own):
                k, at = self.pieces[piece]
                words[r] = self.items[k][1][at : at + size]
            tables = []
            for sig in _signatures(words.ravel(), np.arange(len(own)) * size, size, draws):
                order = np.argsort(sig, kind="stable")
                tables.append((sig[order], np.array(own, np.int32)[order]))
            self.classes.append((size, max(0, size - 1 - 2 * lost[size]), draws, tables))
        self.pairs = np.zeros(1 << 22, bool)  # word pairs of items, hashed
        for _, seq in self.items:
            self.pairs[self._pair(seq.astype(np.int64))] = True

    @staticmethod
    def _pair(words: np.ndarray) -> np.ndarray:
        return (words[:-1] * 2654435761 + words[1:]) & 0x3FFFFF

    def masks(self, k: int) -> dict[int, int]:
        """Where an item has each of its words, as bits."""
        out: dict[int, int] = {}
        for place, word in enumerate(self.items[k][1].tolist()):
            out[word] = out.get(word, 0) | 1 << place
        return out

    def search(self, docs: list[str | None]) -> list[tuple[int, int, int]]:
        """(document's position, item's position, distance) of every verified match."""
        tokens = Tokens(docs)
        return self.find(tokens.owners, tokens.as_words(self.words))

    def find(self, owners: list[int], texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """The same for texts as words of the block's vocabulary, with the documents' positions."""
        pad = np.zeros(self.longest + 1, np.int32)
        some = [k for k, t in enumerate(texts) if t.any()]
        if not some or not self.items:
            return []
        owners, parts = [owners[k] for k in some], [np.concatenate([texts[k], pad]) for k in some]
        sizes = [len(t) for t in parts]
        words, ends = np.concatenate(parts), np.cumsum(sizes)
        known = np.flatnonzero(words)
        known = known[known < len(words) - 1]
        known = known[words[known + 1] > 0]
        known = known[self.pairs[(words[known] * np.int64(2654435761) + words[known + 1]) & 0x3FFFFF]]
        pairs = np.zeros(len(words) + 1, np.int32)
        pairs[known + 1] = 1
        pairs = np.cumsum(pairs, dtype=np.int32)  # item pairs that start before a word
        found: dict[tuple[int, int], int] = {}
        tried, masked = set(), {}
        for size, need, draws, tables in self.classes:
            starts = np.flatnonzero((pairs[size - 1 :] - pairs[: len(pairs) - size + 1] >= max(need, 1))[: len(words) - size + 1] if need else words[: len(words) - size + 1] > 0)
            for part in np.array_split(starts, len(starts) // 200_000 + 1):
                if not len(part):
                    continue
                near = np.zeros(len(words) + 1, np.int32)  # words that some window covers
                near[part] = 1
                np.subtract.at(near, part + size, 1)
                near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                met = []
                for sig, (keys, items) in zip(_signatures(words[near], np.searchsorted(near, part), size, draws), tables):
                    lo = np.searchsorted(keys, sig, "left")
                    hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == sig)
                    lo, hi = lo[hit], np.searchsorted(keys, sig[hit], "right")
                    while len(hit):
                        met.append(np.stack([part[hit], items[lo]]))
                        lo += 1
                        more = hi > lo
                        hit, lo, hi = hit[more], lo[more], hi[more]
                if not met:
                    continue
                for at, piece in np.unique(np.concatenate(met, axis=1), axis=1).T.tolist():
                    d = int(np.searchsorted(ends, at, "right"))
                    k, before = self.pieces[piece]
                    p = at - before  # where the item starts, give or take its edits
                    m = len(self.items[k][1])
                    slack = int(self.edits * m) + 4
                    wide = slack + 4
                    spot = (d, k, p // wide)
                    if spot in tried or found.get((d, k)) == 0:
                        continue
                    tried.add(spot)
                    # holds every run of few enough edits for all ``p`` of the spot
                    start, stop = max(p // wide * wide - slack, int(ends[d]) - sizes[d]), min((p // wide + 1) * wide + m + slack, int(ends[d]))
                    if k not in masked:
                        masked = {k: self.masks(k)} if len(masked) > 64 else masked | {k: self.masks(k)}
                    run = words[start:stop].tolist()
                    if len(masked[k].keys() - run) > int(self.edits * m):
                        continue  # an edit takes one word of the item at most
                    got = edit_distance_within(masked[k], m, run)
                    if got <= int(self.edits * m) and got < found.get((d, k), m + 1):
                        found[d, k] = got
        return [(owners[d], k, got) for (d, k), got in sorted(found.items())]


def _blocks(items: DataFrame, edits: float, block: int) -> list[Broadcast]:
    """The items' indexes in id order; the driver holds one block of items at a time."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text")
    out, held, words = [], [], 0
    send = lambda part: out.append(items.sparkSession.sparkContext.broadcast(Index(part, edits)))  # at most ``BLOCK_WORDS`` words, or one item
    for item_id, text in rows.toLocalIterator():
        n = text.count(" ") + 1
        if held and (len(held) == block or words + n > BLOCK_WORDS):
            send(held)
            held, words = [], 0
        held.append((item_id, text))
        words += n
    if held:
        send(held)
    return out


def _search_rows(indexes: list[Broadcast], texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(row, block, item, distance) of every match, over some millions of characters at a time."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and chars < 4_000_000:
            chars += len(texts[hi] or "")
            hi += 1
        tokens = Tokens(texts[lo:hi])
        for block, sent in enumerate(indexes):
            index = sent.value
            for k, item, distance in index.find(tokens.owners, tokens.as_words(index.words)):
                yield lo + k, block, item, distance
            if len(indexes) > HELD and block >= HELD and hasattr(sent, "_value"):
                del sent._value  # read again from the executor's copy when its turn comes
        lo = hi


def contaminated(docs: DataFrame, items: DataFrame, edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, distance, n_item_words, similarity)`` of every document with an item's passage."""
    indexes = _blocks(items, edits, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, part, i, d in _search_rows(indexes, b.column(1).to_pylist()):
                item_id, seq = indexes[part].value.items[i]
                rows.append((b.column(0)[k].as_py(), item_id, d, len(seq), 1 - d / len(seq)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "distance", "n_item_words", "similarity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS)


def clean(docs: DataFrame, items: DataFrame, edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that have no item's passage."""
    at, indexes = docs.columns.index("text"), _blocks(items, edits, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = {k for k, *_ in _search_rows(indexes, b.column(at).to_pylist())}
            yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
