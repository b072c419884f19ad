"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two words by their three-letter subsequences within six places, each
occurrence weighed by ``DECAY`` to the power of its gaps, and is normalised; word ends are letters
too. So an insult with inserted characters, other endings or gaps keeps most of its kernel. Words
are mapped by Nyström's method on landmark words and separated by a squared-hinge linear SVM. The
decision is a weighted sum of kernels with landmarks, hence linear in the subsequence features, and is
stored and evaluated in that form: one table of ``64**3`` weights whatever the corpus.

Training reads at most ``SAMPLE`` labelled documents of at most ``LONGEST`` characters, cut into
sentences that carry their document's label. A clean document's sentences are all clean; in a toxic
one the sentence's likeliest words are the positive instances, chosen anew as the machine learns.
A document scores by its ``WORST`` worst distinct words, through a logistic fit on the
training documents.

Whole texts are scored, row by row, also rows that share an id. Null and empty texts have no word and get the score of
the lowest margin; null labels are ignored, repeated label rows count once, an empty table gives no rows. Other columns,
whatever their names, are ignored (``score``) or kept as they are (``accepted``).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import slices

#: Most labelled documents (half of either class, if there are enough) and their longest text in training.
SAMPLE, LONGEST = 6000, 20_000
LANDMARKS, DECAY, SPAN, PIECE, WORST = 320, 0.7, 6, 24, 4
THRESHOLD = 0.3
#: A positive instance's least log odds, and the least share of toxic documents that have it at first.
ODDS, SUPPORT = 3.0, 0.008
NOTHING = -3.0
#: Documents at a time, words remembered and words at a time, which bound a task's memory.
SLICE, SLICE_BYTES, KEPT, WORDS = 400, 2_000_000, 250_000, 4000
_SPACED = re.compile(r"(?<!\S)(?:[^\s](?:[ \t]+|$)){4,}")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_SENTENCE = re.compile(r"[.!?\n]+")


def units(text: str) -> set[str]:
    """Distinct lower-case words of a text, and runs of single characters joined to words."""
    text = text.lower()
    out = set(text.split())
    for m in _SPACED.finditer(text):
        out.add("".join(m.group().split()))
    return out


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int):
    if n not in _TRIPLES:
        _TRIPLES[n] = _make_triples(n)
    return _TRIPLES[n]


def _make_triples(n: int):
    t = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    a = np.array(t, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], (DECAY ** (a[:, 2] - a[:, 0] - 2)).astype(np.float64)


def _codes(word: str) -> list[int]:
    return [27, *(ord(c) - 96 if "a" <= c <= "z" else 29 + ord(c) % 35 for c in word), 28]


def features(words: list[str]):
    """(row, feature, weight) of the normalised subsequence features, a row for each word of 1 to ``PIECE`` letters."""
    rows, feats, weights = [], [], []
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        i, j, k, w = _triples(int(n) + 2)
        for part in np.array_split(at, max(1, len(at) * len(i) // 500_000 + 1)):
            if not len(part):
                continue
            c = np.array([_codes(words[x]) for x in part], dtype=np.int64)
            f = (c[:, i] << 12) | (c[:, j] << 6) | c[:, k]
            key = (np.arange(len(part))[:, None] << 18 | f).ravel()
            order = np.argsort(key, kind="stable")
            ks = key[order]
            first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
            s = np.add.reduceat(np.broadcast_to(w, f.shape).ravel()[order], first)
            r = ks[first] >> 18
            norm = np.sqrt(np.bincount(r, s * s, len(part)))
            rows.append(part[r])
            feats.append(ks[first] & 0x3FFFF)
            weights.append(s / norm[r])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(weights)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def pieces(token: str) -> list[str]:
    """A token without edge punctuation, in overlapping pieces if it is longer than ``PIECE``."""
    w = _EDGE.sub("", token)
    if len(w) <= PIECE:
        return [w] if w else []
    return [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]


@dataclass(frozen=True)
class ToxicModel:
    table: np.ndarray  # weight of each subsequence feature
    bias: float
    scale: tuple[float, ...]  # of the worst words' margins in falling order, and a constant

    def margins(self, tokens: list[str]) -> np.ndarray:
        """The machine's margin of each token (its worst piece)."""
        parts = [pieces(t) for t in tokens]
        flat = [p for ps in parts for p in ps]
        own = np.full(len(flat), self.bias)
        for lo in range(0, len(flat), WORDS):
            r, f, w = features(flat[lo : lo + WORDS])
            own[lo : lo + WORDS] += np.bincount(r, w * self.table[f], len(flat[lo : lo + WORDS]))
        out = np.full(len(tokens), NOTHING)
        np.maximum.at(out, np.repeat(np.arange(len(tokens)), [len(p) for p in parts]), np.clip(own, NOTHING, 3.0))
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        """Scores of documents, from the margins of their worst words (a row each)."""
        return 1 / (1 + np.exp(-np.clip(worst @ np.array(self.scale[:-1]) + self.scale[-1], -35, 35)))


def worst_margins(margins: np.ndarray) -> np.ndarray:
    """The ``WORST`` highest of a document's margins, falling."""
    if len(margins) < WORST:
        margins = np.concatenate([margins, np.full(WORST - len(margins), NOTHING)])
    return np.sort(np.partition(margins, len(margins) - WORST)[-WORST:])[::-1]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float, rounds: int = 30):
    """Squared-hinge linear SVM with a bias, by Newton steps on the points inside the margin."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(z1.shape[1]), np.full(z1.shape[1], reg)
    ridge[-1] = reg * 1e-2
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        za, wa = z1[active], weight[active]
        w = np.linalg.solve((za * wa[:, None]).T @ za + np.diag(ridge), za.T @ (wa * y[active]))
        now = y * (z1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], w[-1]


def _kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel matrix of two word lists, through the (few) features that ``b`` has."""
    rb, fb, wb = features(b)
    used, at = np.unique(fb, return_inverse=True)
    mb = np.zeros((len(used), len(b)), np.float32)
    mb[at, rb] = wb
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(a), 1000):
        ra, fa, wa = features(a[lo : lo + 1000])
        pos = np.searchsorted(used, fa)
        ok = (pos < len(used)) & (used[np.minimum(pos, len(used) - 1)] == fa)
        ma = np.zeros((len(a[lo : lo + 1000]), len(used)), np.float32)
        ma[ra[ok], pos[ok]] = wa[ok]
        out[lo : lo + 1000] = ma @ mb
    return out


def _machine(pos: Counter, neg: Counter, seed: int) -> tuple[np.ndarray, float]:
    """Nyström map on landmarks and the SVM upon it, folded into a table of feature weights."""
    rng = np.random.default_rng(seed)
    p, n = sorted(pos, key=lambda w: (-pos[w], w)), sorted(neg, key=lambda w: (-neg[w], w))
    marks = p[: LANDMARKS // 2]
    rest = [w for w in n if w not in set(marks)]
    marks = marks + rest[: LANDMARKS // 4] + [rest[i] for i in rng.permutation(len(rest))[: LANDMARKS // 4] if i >= LANDMARKS // 4]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = _kernel(p + n, marks) @ root
    y = np.concatenate([np.ones(len(p)), -np.ones(len(n))])
    weight = np.concatenate([np.sqrt([pos[w] for w in p]), np.sqrt([neg[w] for w in n])])
    weight[: len(p)] *= 0.5 / weight[: len(p)].sum()
    weight[len(p) :] *= 0.5 / weight[len(p) :].sum()
    w, b = _svm(z, y, weight, reg=2e-4)
    alpha, table = root @ w, np.zeros(1 << 18)
    r, f, v = features(marks)
    np.add.at(table, f, v * alpha[r])
    return table, float(b)


def fit_texts(texts: list[str], labels: list[int], seed: int = 5) -> ToxicModel:
    """Train on whole texts with 0/1 labels."""
    seen: dict[str, int] = {}
    for t, y in sorted(zip(texts, labels)):
        seen.setdefault(t, y)
    docs = [{p for s in _SENTENCE.split(t) for u in units(s) for p in pieces(u)} for t in seen]
    y = np.array(list(seen.values()), dtype=np.int64)
    nt, nc = int(y.sum()), int((1 - y).sum())
    if not nt or not nc:
        p = 0.5 if not len(y) else (nt + 0.5) / (len(y) + 1)
        return ToxicModel(np.zeros(1 << 18), 0.0, (0.0,) * WORST + (float(np.log(p / (1 - p))),))
    tox, clean, families = Counter(), Counter(), set()
    for d, label, t in zip(docs, y, seen):
        w = t.split()
        family = (int(label), min((_hash(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0))  # near copies mostly share their least shingle hash
        if family not in families or not label:
            (tox if label else clean).update(d)
        families.add(family)
    odds = {w: np.log((c + 0.3) / (nt + 1)) - np.log((clean[w] + 0.3) / (nc + 1)) for w, c in tox.items()}
    pos: Counter = Counter()
    for d, label in zip(docs, y):
        if label and d:
            for w in sorted(d, key=lambda w: (-odds.get(w, -9), w))[:2]:
                if odds.get(w, 0) > ODDS and tox[w] >= (max(3, SUPPORT * nt) if nt >= 20 else 1):
                    pos[w] += 1
    rng = np.random.default_rng(seed)
    common = sorted(clean, key=lambda w: (-clean[w], w))
    neg = {w: clean[w] for w in common[:1500]} | {common[i]: clean[common[i]] for i in rng.permutation(len(common))[:3500]}
    model = None
    for step in range(3):
        if not pos:
            break
        for w in pos:
            neg.pop(w, None)
        table, bias = _machine(pos, Counter(neg), seed + step)
        model = ToxicModel(table, bias, (1.0,) + (0.0,) * WORST)
        vocab = sorted(set().union(*docs))
        margin = dict(zip(vocab, model.margins(vocab)))
        if step < 2:
            for w in sorted((w for w in clean if w not in pos), key=lambda w: (-margin[w], w))[:1500]:
                neg[w] = clean[w]  # the hardest clean words
            pos = Counter()
            for d, label in zip(docs, y):
                if label and d:
                    for w in sorted(d, key=lambda w: (-(margin.get(w, NOTHING) + 0.3 * odds.get(w, -9)), w))[:2]:
                        if margin.get(w, NOTHING) > 0 and odds.get(w, -9) > ODDS:
                            pos[w] += 1
    if model is None:
        p = (nt + 0.5) / (nt + nc + 1)
        return ToxicModel(np.zeros(1 << 18), 0.0, (0.0,) * WORST + (float(np.log(p / (1 - p))),))
    top = np.array([worst_margins(np.array([margin[w] for w in sorted(d)])) for d in docs])
    x = np.hstack([top, np.ones((len(top), 1))])
    target = np.where(y == 1, (nt + 1) / (nt + 2), 1 / (nc + 2))
    w, ridge = np.zeros(WORST + 1), np.array([0.3] * WORST + [1e-4])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, x.T @ (target - q) - ridge * w)
        w = w + d / max(1.0, np.abs(d).max() / 2)
        if np.abs(d).max() < 1e-6:
            break
    return ToxicModel(model.table, model.bias, tuple(float(v) for v in w))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> ToxicModel:
    """Train on labelled rows where ``learn`` holds (over ``doc_id``), at most ``sample`` of them."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = rows.where("y = 1").orderBy(*order).limit(sample // 2).unionByName(rows.where("y = 0").orderBy(*order).limit(sample // 2))
    got = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").toPandas()  # bounded: ``sample`` texts of ``LONGEST``
    return fit_texts(got["text"].tolist(), got["y"].tolist())


def _scorer(model: ToxicModel, at: int):
    """(batch, its scores) of every slice of the batches, texts in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        known: dict[str, float] = {}
        for b in slices(batches, at, SLICE, SLICE_BYTES):
            sets = [units(t) if t else set() for t in b.column(at).to_pylist()]
            if len(known) > KEPT:
                known.clear()
            new = list(set().union(*sets).difference(known)) if sets else []
            known.update(zip(new, model.margins(new).tolist()))
            top = np.full((len(sets), WORST), NOTHING)
            for k, s in enumerate(sets):
                if s:
                    top[k] = worst_margins(np.fromiter(map(known.__getitem__, s), np.float64, len(s)))
            yield b, model.score(top)

    return run


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``, 0 to 1."""
    rows = _scorer(model, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in rows(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    rows = _scorer(model, docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in rows(batches):
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
