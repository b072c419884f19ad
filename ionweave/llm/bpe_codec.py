"""BPE encoding and decoding over a minimal acyclic transducer.

The corpus' most frequent words (runs without white space, as they stand) are compiled, with the ids
that the tokenizer gives them, into a minimal acyclic automaton that shares prefixes and suffixes. Every arc
carries how many words come before it, so reading a word adds up to its ordinal, which points at its
ids. The automaton is one flat file in the shared folder; Spark hands it to each executor once and the
workers map it into memory. Words it lacks are split and merged exactly by the tokenizer's rules.

Counts are over all documents; the lexicon keeps the most frequent words of at most ``WIDEST`` bytes, up
to ``LEXICON`` (which words it holds changes speed, never ids). Null and empty texts have no ids and decode
to the empty text; equal texts have equal ids; repeated rows and ids each give their row; whole texts are encoded, however
long; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import cut, shared_dir

LEXICON, WIDEST, KEPT, SLICE, LONG, SLOTS = 60_000, 48, 180_000, 1200, 48, (1 << 20) - 1
NEVER = 1 << 60
#: Words counted less often, in a task or in all, are not worth compiling.
TASK_RARE, RARE = 2, 4
#: White space of the tokenizer's patterns; Python's split() also takes these four control characters.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Tokenizer:
    """Exact encoding by a tokenizer file of the kind 'BPE with word ends'."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model, vocab = t["model"], t["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.specials = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.tokens = {i: s for s, i in (vocab | self.specials).items()}
        pattern = next(p["pattern"]["Regex"] for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        letters = byte_letters()
        self.inner, self.last = [vocab.get(c) for c in letters], [vocab.get(c + self.end) for c in letters]
        self.ranks: dict[int, int] = {}  # by a pair's two ids in one number
        self.joined: list[int] = []  # the id that a merge of this rank makes
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.joined.append(vocab[a + b])
        self.gaps = None in self.inner or None in self.last
        fill = lambda ids: np.array([-1 if i is None else i for i in ids], np.int64)
        self.inner_ids, self.last_ids, self.joined_ids = fill(self.inner), fill(self.last), np.array([*self.joined, 0], np.int64)
        self.keys = np.array(sorted(self.ranks) or [-1], np.int64)
        self.rank_of = np.array([self.ranks.get(k, NEVER) for k in self.keys.tolist()], np.int64)
        spot = (self.keys * 0x9E3779B1 >> 7) & SLOTS
        self.slots = np.full(SLOTS + 1, -1, np.int64)  # a key's place by its hash; -2 where several meet
        self.slots[spot] = np.arange(len(self.keys))
        met, n = np.unique(spot, return_counts=True)
        self.slots[met[n > 1]] = -2

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, ``NEVER`` for those that don't merge."""
        key = left << 20 | right
        at = self.slots[(key * 0x9E3779B1 >> 7) & SLOTS]
        many = at == -2
        if many.any():
            at[many] = np.minimum(np.searchsorted(self.keys, key[many]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[at] == key), self.rank_of[at], NEVER)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word's bytes: the pair of lowest rank, leftmost first, is joined until none is left.

        Words of one length advance together, a join a step, so a step is a few array operations.
        """
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == n)
            if n > LONG or self.gaps:
                for r in rows.tolist():
                    out[r] = np.array(self._merge_long(words[r]), "<u4").tobytes()
                continue
            if not n:
                continue
            by = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8).reshape(-1, n)
            ids = self.inner_ids[by]
            ids[:, -1] = self.last_ids[by[:, -1]]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while True:
                size = ids.shape[1]
                at = ranks.argmin(axis=1) if size > 1 else np.zeros(len(rows), np.int64)
                best = ranks[np.arange(len(rows)), at] if size > 1 else np.full(len(rows), NEVER)
                done = best == NEVER
                if done.any():
                    flat = ids[done].astype("<u4").tobytes()
                    for k, r in enumerate(rows[done].tolist()):
                        out[r] = flat[4 * size * k : 4 * size * (k + 1)]
                    go = ~done
                    rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                ids[line, at] = self.joined_ids[best]
                col = np.arange(size - 1)
                ids = np.take_along_axis(ids, col + (col > at[:, None]), axis=1)
                ranks = np.take_along_axis(ranks, (col := np.arange(size - 2)) + (col >= at[:, None]), axis=1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
                if len(left):
                    ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
                if len(right):
                    ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for one very long word; bytes without a token are left out."""
        seq = [s for s in [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]] if s is not None]
        n, get, joined = len(seq), self.ranks.get, self.joined
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k, seq[k], seq[k + 1]) for k in range(n - 1) if (r := get(seq[k] << 20 | seq[k + 1], NEVER)) < NEVER]
        heapify(heap)
        while heap:
            rank, k, a, b = heappop(heap)
            j = after[k]
            if seq[k] != a or j < 0 or seq[j] != b:
                continue
            new = joined[rank]
            seq[k], seq[j] = new, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := get(new << 20 | seq[after[k]], NEVER)) < NEVER:
                    heappush(heap, (r, k, new, seq[after[k]]))
            p = before[k]
            if p >= 0 and (r := get(seq[p] << 20 | new, NEVER)) < NEVER:
                heappush(heap, (r, p, seq[p], new))
        return [s for s in seq if s >= 0]

    def pieces_of(self, run: str) -> list[str]:
        """The pieces of a run without white space."""
        low = run.replace("Σ", "σ").lower()
        return [low] if low.isalpha() else self.split.findall(low)

    def words(self, runs: list[str]) -> list[bytes]:
        """The packed ids of runs without white space."""
        parts = [self.pieces_of(r) for r in runs]
        distinct = list(dict.fromkeys(p for ps in parts for p in ps))
        packed = dict(zip(distinct, self.merge_many([p.encode() for p in distinct])))
        return [packed[ps[0]] if len(ps) == 1 else b"".join([packed[p] for p in ps]) for ps in parts]

    def runs(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Whether a part is a special token, and its runs."""
        for k, part in enumerate(self.special.split(text) if self.special and "<|" in text else [text]):
            if k % 2:
                yield True, [part]
            elif part:
                part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                yield False, [r for r in _SPACE.split(part) if r] if _CONTROL.search(part) else part.split()


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The minimal acyclic automaton of ``words`` and their packed ids, as the bytes of its file."""
    keys = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)) of frozen states
    path: list[list] = [[False, []]]  # open states along the last word

    def freeze(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    previous = b""
    for w in keys:
        common = 0
        while common < min(len(w), len(previous)) and w[common] == previous[common]:
            common += 1
        freeze(common + 1)
        for c in w[common:]:
            path[-1][1].append((c, -1))
            path.append([False, []])
        path[-1][0] = True
        previous = w
    freeze(1)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    count = [0] * len(states)  # words from a state on; a state's arcs lead to earlier ones
    labels, targets, skips, starts, finals = bytearray(), [], [], [], bytearray()
    for s, (final, arcs) in enumerate(states):
        starts.append(len(labels))
        finals.append(final)
        total = int(final)
        for c, t in arcs:
            labels.append(c)
            targets.append(t)
            skips.append(total)
            total += count[t]
        count[s] = total
    starts.append(len(labels))
    offsets = np.concatenate([[0], np.cumsum([len(words[k]) // 4 for k in keys])]).astype("<i4") if keys else np.zeros(1, "<i4")
    parts = [np.array(x, "<i4").tobytes() for x in (starts, targets, skips)] + [offsets.tobytes(), b"".join(words[k] for k in keys), bytes(finals), bytes(labels)]
    head = struct.pack("<8i", root, *map(len, parts))
    return head + b"".join(parts)


class Lexicon:
    """Lookup in a mapped automaton file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8i", self.map, 0)
        view, at, parts = memoryview(self.map), 32, []
        for n in sizes:
            parts.append((at, view[at : at + n]))
            at += n
        self.starts, self.targets, self.skips, self.offsets = (p.cast("i") for _, p in parts[:4])
        self.ids, self.finals, self.labels = parts[4][1], parts[5][1], parts[6][0]
        self.single = [bytes([b]) for b in range(256)]

    def find(self, word: bytes) -> bytes | None:
        """The word's ids, packed, or None."""
        state, ordinal, find, at = self.root, 0, self.map.find, self.labels
        starts, targets, skips, single = self.starts, self.targets, self.skips, self.single
        for c in word:
            arc = find(single[c], at + starts[state], at + starts[state + 1]) - at
            if arc < 0:
                return None
            ordinal += skips[arc]
            state = targets[arc]
        return bytes(self.ids[4 * self.offsets[ordinal] : 4 * self.offsets[ordinal + 1]]) if self.finals[state] else None


def word_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """``(word, n)`` of all runs without white space, counted in each task before the shuffle.

    Counts below ``least`` in a task are left out of its sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            some = [(w, c) for w, c in n.items() if c >= least]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([c for _, c in some], pa.int64())], ["word", "n"])

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    n.update(t.split())
            if len(n) > 3 * KEPT:
                yield out()
                n = Counter()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: Tokenizer, size: int = LEXICON) -> str:
    """Compile the frequent words into the shared folder, register the file with Spark, return its name."""
    spark = docs.sparkSession
    short = cut(word_counts(docs, TASK_RARE).where((F.octet_length("word") <= WIDEST) & (F.col("n") >= RARE)))
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for lv, n in sorted(short.groupBy(level).count().collect(), reverse=True):  # some hundred levels
        if total + n > size:
            break
        least, total = lv, total + n
    top = [r["word"] for r in short.where(level >= least).collect()] if least is not None else []  # at most ``size`` short words
    data = compile_lexicon({w.encode(): ids for w, ids in zip(top, tokenizer.words(top))})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm, target = spark._jvm, f"{shared_dir(spark)}/{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(data))
    stream.close()
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(target)
    return name


ENCODED = "doc_id long, n_tokens long, ids binary"


def _encoder(sent, name: str):
    """Batches of (doc_id, text) to batches of (doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, lex = Tokenizer(sent.value), Lexicon(SparkFiles.get(name))
        specials = {s: np.array([i], "<u4").tobytes() for s, i in tok.specials.items()}
        known: dict[str, bytes] = {}
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            seen: Counter = Counter()
            texts = [list(tok.runs(t)) if t else [] for t in b.column(1).to_pylist()]
            for t in texts:
                for special, runs in t:
                    if not special:
                        seen.update(runs)
            if len(known) > KEPT:
                known = {}
            unseen = []
            for r in seen.keys() - known.keys():
                got = lex.find(r.encode()) if seen[r] > 1 and len(r) <= WIDEST else None  # rare words are seldom in it
                if got is None:
                    unseen.append(r)
                else:
                    known[r] = got
            known.update(zip(unseen, tok.words(unseen)))
            ids = known.__getitem__
            out = [b"".join(map(ids, t[0][1])) if len(t) == 1 and not t[0][0] else b"".join([specials[r] if special else ids(r) for special, runs in t for r in runs]) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoder(sent):
    """Batches with packed ids to the same with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.__getitem__
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            texts = [" ".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return run


def _spec(tokenizer_file: str) -> str:
    with open(tokenizer_file, encoding="utf-8") as f:
        return f.read()


def _token_texts(tok: Tokenizer) -> list[str]:
    return [tok.tokens.get(i, "") for i in range(max(tok.tokens) + 1)]


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, tokenizer_file: str, size: int = LEXICON) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: ids packed as little-endian unsigned 32-bit integers."""
    spec = _spec(tokenizer_file)
    name = build_lexicon(docs, Tokenizer(spec), size)
    return _narrow(docs).mapInArrow(_encoder(docs.sparkSession.sparkContext.broadcast(spec), name), ENCODED)


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """``encoded`` with ``text``: the tokens of ``ids`` as the tokenizer writes them, special ones kept."""
    sent = encoded.sparkSession.sparkContext.broadcast(_token_texts(Tokenizer(_spec(tokenizer_file))))  # one vocabulary
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(sent), ENCODED + ", text string")


def round_trip(docs: DataFrame, tokenizer_file: str, size: int = LEXICON) -> DataFrame:
    """``(doc_id, n_tokens, ids, text)``: encoded, and decoded from the ids, in one pass of one worker."""
    spec, sc = _spec(tokenizer_file), docs.sparkSession.sparkContext
    tok = Tokenizer(spec)
    name = build_lexicon(docs, tok, size)
    encoder, decoder = _encoder(sc.broadcast(spec), name), _decoder(sc.broadcast(_token_texts(tok)))
    return _narrow(docs).mapInArrow(lambda batches: decoder(encoder(batches)), ENCODED + ", text string")
