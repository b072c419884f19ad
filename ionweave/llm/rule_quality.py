"""Document quality by a sparse rule ensemble.

Boosted shallow trees over text statistics give conjunctive rules (every path from a root); a lasso
logistic regression keeps and weighs few of them; the kept rules are compiled into one Spark column
expression, so scoring is native and reads each text once. The fit uses at most ``SAMPLE`` labelled
documents (those with the smallest hashed ids), of which only the statistics reach the driver.

A null text counts as empty; null labels are ignored; without both classes the score is constant;
repeated label rows of a document count once; an empty table gives no rows. Rows are scored one by one, also rows
that share an id. Other columns, whatever their names, are ignored (``score``) or kept as they are (``accepted``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents used to fit.
SAMPLE = 6000
THRESHOLD = 0.5
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column's name begins with."""
    prefix = "st_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with one double column per statistic (names returned, none of them taken), each from the whole text."""
    t, prefix = F.coalesce(F.col(text), F.lit("")), free_prefix(docs.columns)
    w, ln = f"{prefix}words_of", f"{prefix}lines_of"
    base = docs.withColumn(w, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn(ln, F.split(t, "\n"))
    words, lines, n = F.size(w), F.size(ln), F.greatest(F.length(t), F.lit(1))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    share = {
        "upper": without(UPPER) / n,
        "digit": without(DIGITS) / n,
        "stop": without(".") / n,
        "comma": without(",") / n,
        "exclaim": without("!?") / n,
        "pipe": without("|") / n,
        "symbol": without("#$%&*+=<>^~_@\\/{}[]") / n,
        "newline": without("\n") / n,
        "mean_word": F.length(t) / F.greatest(words, F.lit(1)),
        "words": F.log1p(words.cast("double")),
        "distinct_words": F.size(F.array_distinct(w)) / F.greatest(words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(ln)) / F.greatest(lines, F.lit(1)),
        "words_line": F.log1p(words / F.greatest(lines, F.lit(1))),
    }
    stats = base.withColumns({prefix + k: v.cast("double") for k, v in share.items()}).drop(w, ln)
    return stats, [prefix + k for k in share]


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is greater, threshold) of each condition


@dataclass(frozen=True)
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, names: list[str]) -> Column:
        """The score, 0 to 1, as a Spark expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, greater, at in rule:
                holds = holds & ((F.col(names[k]) > at) if greater else (F.col(names[k]) <= at))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(x, grad, rows, least):
    best = (1e-9, None)
    total, count = grad[rows].sum(), len(rows)
    for k, (codes, cuts) in enumerate(x):
        c = codes[rows]
        s, n = np.bincount(c, grad[rows], len(cuts) + 1).cumsum()[:-1], np.bincount(c, minlength=len(cuts) + 1).cumsum()[:-1]
        ok = (n >= least) & (count - n >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(count - n, 1) - total**2 / count, 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (k, j))
    return best[1]


def _paths(x, grad, hess, rows, depth, least, rule, found, step, out):
    """Grow a tree; ``found`` gets every path from its root, ``out`` the boosted values."""
    cut = _split(x, grad, rows, least) if depth and len(rows) >= 2 * least else None
    if cut is None:
        out[rows] += step * np.clip(grad[rows].sum() / (hess[rows].sum() + 1), -4, 4)
        return
    k, j = cut
    low = x[k][0][rows] <= j
    for part, greater in ((rows[low], False), (rows[~low], True)):
        longer = rule + ((k, greater, float(x[k][1][j])),)
        found.append(longer)
        _paths(x, grad, hess, part, depth - 1, least, longer, found, step, out)


def _lasso(r: np.ndarray, y: np.ndarray, lam: float, start=None, rounds: int = 250):
    """Logistic regression with an L1 penalty by accelerated proximal steps; the bias is free."""
    n, m = r.shape
    w, b = start if start is not None else (np.zeros(m, np.float32), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    lip = 0.25 * (np.linalg.norm(r, "fro") ** 2 / n if m < 2 else _top_eigen(r) / n) + 0.25
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        nw = v - (r.T @ g / n) / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - lam / lip, 0)
        nb = c - g.mean() / lip
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw.astype(np.float32), float(nb), nt
    return w, b


def _top_eigen(r: np.ndarray) -> float:
    v = np.ones(r.shape[1], np.float32)
    for _ in range(20):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    return float(np.linalg.norm(r @ v) ** 2)


def fit_matrix(values: np.ndarray, y: np.ndarray, trees: int = 80, most_rules: int = 60, seed: int = 7) -> RuleModel:
    """The rule ensemble for ``values`` (rows x statistics) and 0/1 labels ``y``."""
    rng, n = np.random.default_rng(seed), len(y)
    if n == 0 or y.min() == y.max():
        p = 0.5 if n == 0 else (y.sum() + 0.5) / (n + 1)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    x = []
    for k in range(values.shape[1]):
        cuts = np.unique(np.quantile(values[:, k], np.linspace(0, 1, 66)[1:-1]))
        x.append((np.searchsorted(cuts, values[:, k], side="left"), cuts))
    f, found, least = np.full(n, np.log(y.mean() / (1 - y.mean()))), [], max(3, n // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(n) < 0.6)
        if len(rows) > 2 * least:
            _paths(x, y - p, p * (1 - p), rows, int(rng.integers(1, 5)), least, (), found, 0.3, f)
    rules = list(dict.fromkeys(tuple(sorted(set(r))) for r in found))
    if not rules:
        p = y.mean()
        return RuleModel([], [], float(np.log(p / (1 - p))))

    def holds(rule):
        ok = np.ones(n, bool)
        for k, greater, at in rule:
            ok &= (values[:, k] > at) if greater else (values[:, k] <= at)
        return ok

    r = np.stack([holds(rule) for rule in rules], axis=1).astype(np.float32)
    _, keep = np.unique(np.packbits(r.astype(bool), axis=0).T, axis=0, return_index=True)
    r, rules = r[:, np.sort(keep)], [rules[i] for i in np.sort(keep)]
    fold = rng.random(n) < 0.25
    if not fold.any() or y[~fold].min() == y[~fold].max():
        fold = np.zeros(n, bool)
    best, start = None, None
    for lam in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005):
        start = _lasso(r[~fold], y[~fold], lam, start)
        test = fold if fold.any() else ~fold
        p = np.clip(1 / (1 + np.exp(-(r[test] @ start[0] + start[1]))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        if best is None or (loss < best[0] and (start[0] != 0).sum() <= most_rules):
            best = (loss, lam)
    lam = best[1]
    w, b = _lasso(r, y, lam)
    while (w != 0).sum() > 2 * most_rules:  # a stronger penalty leaves fewer rules
        lam *= 1.25
        w, b = _lasso(r, y, lam)
    used = np.flatnonzero(w)
    return RuleModel([rules[i] for i in used], [float(w[i]) for i in used], float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> RuleModel:
    """Fit on labelled rows where ``learn`` holds (over ``doc_id``), at most ``sample`` of them."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    stats, names = statistics(rows)
    got = stats.select(F.col("y").cast("double"), *names).toPandas().to_numpy()
    got = got[np.lexsort(got.T)]  # the same fit whatever order rows arrive in
    return fit_matrix(got[:, 1:], got[:, 0])


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``(doc_id, score)`` of every row, 0 to 1."""
    stats, names = statistics(docs.select("doc_id", "text"))
    return stats.select("doc_id", model.column(names).alias("score"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more."""
    stats, names = statistics(docs)
    return stats.where(model.column(names) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
