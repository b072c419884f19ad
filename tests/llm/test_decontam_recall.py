"""Recall of op7 at the edit limit, by kind of edits and length of items, and its result against all pairs."""

import random

import numpy as np
import pytest

from ionweave.llm import decontam


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def edited(rng, w, kind, edits=0.2):
    w, n = list(w), int(edits * len(w))
    if kind in ("first", "second"):
        for p in range(kind == "second", len(w), 2)[:n]:
            w[p] = "zzz"
        return w
    for _ in range(n):
        p = rng.randrange(len(w) // 2 if kind == "front" else len(w))
        how = {"delete": 0, "replace": 1, "insert": 2}.get(kind, rng.randrange(3))
        w[p : p + 1] = ([], ["zzz"], [w[p], "yy"])[how]
    return w


def recall(lengths, kind, count, seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(word(rng) for _ in range(rng.choice(lengths)))) for k in range(count)]
    docs = [" ".join(["the"] * rng.randint(0, 40) + edited(rng, t.split(), kind) + ["on"] * rng.randint(0, 40)) for _, t in items]
    return len({d for d, k, _ in decontam.Index(items).search(docs) if d == k}) / count


@pytest.mark.parametrize("kind", decontam.KINDS)
def test_recall_by_kind(kind):
    assert recall(range(12, 61), kind, 200) >= 0.95
    assert recall(range(12, 24), kind, 150) >= 0.95  # items of one piece


@pytest.mark.parametrize("kind", ["spread", "front", "delete"])
@pytest.mark.parametrize("words", [100, 300, 1000])
def test_recall_by_length(words, kind):
    assert recall([words], kind, 30) >= 0.97


def best_run(item, doc):
    """Smallest edit distance of an item to any run of a document's words."""
    row = np.zeros(len(doc) + 1, int)
    for i, a in enumerate(item, 1):
        now = np.empty_like(row)
        now[0] = i
        for j, b in enumerate(doc, 1):
            now[j] = min(row[j - 1] + (a != b), row[j] + 1, now[j - 1] + 1)
        row = now
    return int(row.min())


def test_search_equals_all_pairs():
    rng = random.Random(9)
    vocabulary = [word(rng) for _ in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(25)]
    docs = []
    for k in range(60):
        host = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(k % 3):
            at = rng.randint(0, len(host))
            host[at:at] = edited(rng, rng.choice(items)[1].split(), rng.choice(decontam.KINDS), rng.choice([0, 0.1, 0.2, 0.3]))
        docs.append(" ".join(host))
    split = [t.split() for t in docs]
    want = {(d, k): e for d, w in enumerate(split) for k, (_, t) in enumerate(items) if (e := best_run(t.split(), w)) <= int(0.2 * len(t.split()))}
    got = {(d, k): e for d, k, e in decontam.Index(items).search(docs)}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 30
    assert all(got[p] == want[p] for p in got)


def test_index_does_not_grow_with_the_vocabulary():
    import pickle

    rng = random.Random(4)
    same = [(k, " ".join(["w%d" % rng.randrange(50) for _ in range(200)])) for k in range(40)]
    other = [(k, " ".join(["w%d" % rng.randrange(100_000) for _ in range(200)])) for k in range(40)]
    a, b = (len(pickle.dumps(decontam.Index(x))) for x in (same, other))
    assert b < 1.1 * a  # but for the words themselves
    assert len(pickle.dumps(decontam.Index([(0, " ".join(word(rng) for _ in range(4000)))]))) < 6_000_000


def test_words_are_those_of_the_plain_norm():
    """Tokens are numbered as columns, not one by one; each distinct token is looked at once."""
    texts = ["The CAT, «sat»  on — the (mat)!", None, "", "İstanbul ÉTÉ 'été' … ΣΑΣ mat cat", "--- !!", "x" * 50_000 + " cat."]
    items = [(1, "the cat sat on the mat"), (2, "İstanbul été σας")]
    index, tokens = decontam.Index(items), decontam.Tokens(texts)
    plain = [[index.vocab.get(w, 0) for w in map(decontam.norm, t.split()) if w] for t in texts if t]
    assert tokens.owners == [0, 3, 4, 5]
    assert [t.tolist() for t in tokens.as_words(index.words)] == plain
    assert index.search(texts) == [(0, 0, 0)]
    assert len(decontam.Tokens(["a b a b " * 1000]).forms) == 2
