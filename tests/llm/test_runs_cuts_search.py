"""Periodic runs, fill-in-the-middle and exact top-k search against brute force, with the odd rows they must take."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.llm import fill_middle, norm_search, periodic_runs
from ionweave.llm.queries import _planted

# Extra columns that clash with names the operators use inside.
DOCS = "doc_id long, text string, runs string, copies int, digest string, n long, k long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "r", 9, "d", 5, 6) for i, t in rows], DOCS).repartition(parts)


def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "é É é É é É é É", "\x00 \x01\x00 odd\x85nel nbsp"]
    out += ["a " * 400, "a b " * 300 + "c", ("a a a a a a b " * 7).strip(), ("p q r " * 5 + "z ") * 6, "line\n" * 9 + "end", "\n\n\n", "no newline", "<P>", "a<S>b\nc", "tail <M", "crlf\r\nx\r\n"]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    out += ["\n".join("".join(rng.choice("ab \U0001f600é") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    out += [" ".join(f"w{rng.randint(0, 40)}" for _ in range(900)) + " tick tock" * 30]
    return list(enumerate(out))


def brute_runs(words, min_exp=4, min_length=6):
    """All maximal stretches of a period, less those that a smaller period explains."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in found.items() if m >= max(min_length, min_exp * q))


def expected_runs(i, text, rewrite=None):
    words = (text or "").encode().split()
    words = rewrite(i, words) if rewrite else words
    runs = brute_runs(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    return len(words), sorted(runs, key=lambda r: (r[0], r[2])), b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()


@pytest.mark.parametrize("setting", [{}, {"rewrite": _planted}, {"rewrite": _planted, "long": 60, "work": 150}])
def test_periodic_runs(spark, setting):
    rows = texts() + [(5, "a b a b a b a b"), (5, "a a a a a a a"), (5, "a a a a a a a"), (None, "c c c c c c c"), (None, None)]
    rows += [(7, ("u v w " * 40).strip())] * 3
    df = periodic_runs.periodic_runs(frame(spark, rows), **setting)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()]
    want = [(i, *expected_runs(i, t, setting.get("rewrite"))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_strongest_run(spark):
    runs = [(9, 40, 10), (3, 21, 5), (1, 42, 10), (50, 42, 10), (60, 7, 1)]
    df = spark.createDataFrame([(runs,), (runs[:4],), ([],)], f"runs {periodic_runs.RUNS}")
    got = df.select(periodic_runs.strongest(F.col("runs")).alias("b"), periodic_runs.listed(F.col("runs")).alias("t")).collect()
    assert [r["b"] and tuple(r["b"]) for r in got] == [(60, 7, 1), min(runs[:4], key=lambda r: (-Fraction(r[1], r[2]), r[0])), None]
    assert got[1]["t"] == "9,40,10\n3,21,5\n1,42,10\n50,42,10\n" and got[2]["t"] == ""


def test_runs_inside_one_text():
    rng = np.random.default_rng(4)
    for _ in range(200):
        ids = rng.integers(0, 2, rng.integers(1, 90))
        ids[rng.integers(0, len(ids)) :] = ids[-1] if rng.random() < 0.3 else ids[rng.integers(0, len(ids)) :][:1]
        for exp, least in ((4, 6), (2, 2), (3, 9)):
            assert sorted(periodic_runs.find_runs(ids, min_exp=exp, min_length=least)) == brute_runs(ids.tolist(), exp, least)


def test_long_equal_words():
    """Multiples of a known period cost no comparison: a megabyte of one word ends at once."""
    assert periodic_runs.find_runs(np.zeros(500_000, np.int64)) == [(0, 500_000, 1)]


def brute_cuts(i, text, units):
    text = text or ""
    cut, n = [0], 0
    for u in units(text):
        cut.append(cut[-1] + len(u))
        n += 1
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    a, b, _, d = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    first, second = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[: cut[first]], text[cut[first] : cut[second]], text[cut[second] :]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, text, text
    if d % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("setting", [{}, {"size": 7}, {"size": 5, "long": 30}, {"size": 1, "long": 0}, {"boundary": fill_middle.words, "size": 4, "long": 40}])
def test_fill_in_middle(spark, setting):
    import re

    units = (lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)) if "boundary" not in setting else (lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", t))
    rows = texts() + [(5, "x\ny\nz"), (5, "q\n" * 50), (5, "q\n" * 50), (None, "c\nd"), (None, None)]
    if "boundary" in setting:
        rows = [(i, t and t.lstrip(" \t\n\r\x0b\x0c")) for i, t in rows]
    made = fill_middle.fill_in_middle(frame(spark, rows), **setting)
    got = made.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_cuts(i, t, units) for i, t in rows), key=str)


def test_nothing(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert periodic_runs.periodic_runs(nothing).count() == 0 and fill_middle.fill_in_middle(nothing).count() == 0
    assert norm_search.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_long_texts(spark):
    """Texts of megabytes: one word, and a line a word."""
    rows = [(1, "x" * 3_000_000), (2, "y\n" * 1_000_000)]
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(frame(spark, rows)).collect()}
    assert got[1]["n_words"] == 1 and [tuple(r) for r in got[2]["runs"]] == [(0, 1_000_000, 1)] and got[2]["collapsed"] == "y"
    made = {r["doc_id"]: r for r in fill_middle.fill_in_middle(frame(spark, rows)).collect()}
    assert (made[1]["n"], made[2]["n"]) == (1, 1_000_000)
    assert tuple(made[2])[:6] == brute_cuts(2, rows[1][1], lambda t: t.splitlines(True))[:6]


def brute_top(rows, asks, k):
    clean = [(n, i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in clean:
        if not asks(i):
            continue
        scored = sorted((-int(sum(a * b for a, b in zip(v.tolist(), w.tolist()))), j is None, j or 0, m) for m, j, w in clean if m != n)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("setting", [{}, {"queries": 7, "groups": 3}, {"k": 2, "groups": 1}])
def test_top_products(spark, setting):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 12)) * rng.choice([0.1, 1, 3], (300, 1)) * np.linspace(2, 0.1, 12)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one vector, many times
    rows += [(10, rows[4][1]), (10, rows[10][1]), (None, rows[5][1]), (20, None), (30, []), (40, [1.0, None]), (50, [float("nan")] * 12), (60, [float("inf")] * 12), (70, [1.0, -2.0]), (80, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1.0, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, norm double, part int, rid int").repartition(5)
    got = norm_search.top_products(df, F.col("vec_id") % 10 == 0, **setting)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, lambda i: i is not None and i % 10 == 0, setting.get("k", 5))


def test_bounds_prune():
    """Where lengths fall or the spectrum is steep, most pairs are never scored."""
    rng = np.random.default_rng(9)
    v = np.floor(rng.normal(size=(20_000, 32)) * np.geomspace(300, 3, 32)) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    v = np.floor(v)
    v = v[np.argsort(-(v * v).sum(1))]
    ids = np.arange(len(v))
    search = norm_search.Search(ids[:50], ids[:50], v[:50], norm_search.rotation(v[:1000]), 5)
    search.add(ids, ids, v)
    exact = (v[:50] @ v.T).astype(np.int64)
    exact[np.arange(50), np.arange(50)] = -(1 << 62)
    want = np.sort(exact, 1)[:, ::-1][:, :5]
    assert (search.score == want).all() and search.pairs < 0.3 * 50 * len(v)


def test_too_long_vectors(spark):
    df = spark.createDataFrame([(0, [1e9]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long"):
        norm_search.top_products(df, F.col("vec_id") == 0).collect()
