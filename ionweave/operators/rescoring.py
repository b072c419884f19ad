"""Rescoring of matches with a classifier trained on targets that pass and on decoys, in cross-validated folds.

Folds are dealt by query, so no model scores a query that it, or the choice of its settings, has seen. In each fold a model
learns from decoys and from the targets that pass by the score so far, scores again, and so on.

The random forest's depth and class weights are chosen by cross-validated accuracy within the learning rows of a fold, all settings
side by side. Weights count by their ratio only, so settings of one ratio share their fit. The choice reads at most about ``CHOICE_ROWS``
learning rows of a fold and small forests; the forests that score take all rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.fdr import impute_infinite, q_values
from ionweave.sources.versions import cut

#: Depths and (decoy, target) weights tried, in this order (fixed values); no depth is the greatest that Spark grows.
DEPTHS = (3, 5, 7, 9, None)
WEIGHTS = (None, ("0.1", "1"), ("0.1", "10"), ("1", "0.1"), ("1", "10"), ("10", "0.1"), ("10", "1"))
DEEPEST, CHOICE_ROWS, CHOICE_TREES, TREES, SIDE_BY_SIDE = 30, 2000, 8, 100, 16


@dataclass(frozen=True)
class Setting:
    """One point of the forest's grid."""

    depth: int | None
    weights: tuple[str, str] | None

    @property
    def target_weight(self) -> float:
        """Weight of a target when a decoy's is one."""
        return 1.0 if self.weights is None else float(Fraction(self.weights[1]) / Fraction(self.weights[0]))


GRID = [Setting(d, w) for w in WEIGHTS for d in DEPTHS]


def uncorrelated(df: DataFrame, column: str, threshold: float = 0.95) -> list[int]:
    """Features kept: each one whose absolute correlation with every earlier one is at most ``threshold``."""
    m = Correlation.corr(df, column).first()[0].toArray()
    return [i for i in range(m.shape[0]) if not any(abs(m[j, i]) > threshold for j in range(i))]


class CorrelationThreshold(Transformer):
    """Drops features that correlate with an earlier one."""

    def __init__(self, input_col: str, output_col: str, keep: list[int]):
        super().__init__()
        self.slicer = VectorSlicer(inputCol=input_col, outputCol=output_col, indices=keep)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.slicer.transform(dataset)


def prepare(ssms: DataFrame, features: list[str]) -> DataFrame:
    """``ssms`` with a vector ``x`` of scaled, varying, uncorrelated features."""
    finite = impute_infinite(ssms, features).na.fill(0.0, features)
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), VarianceThresholdSelector(featuresCol="_scaled", outputCol="_varying")]
    scaled = Pipeline(stages=stages).fit(finite).transform(finite)
    return CorrelationThreshold("_varying", "x", uncorrelated(scaled, "_varying")).transform(scaled).drop("_raw", "_scaled", "_varying")


def fold_of(column: str, folds: int, seed: int = 0):
    return F.pmod(F.xxhash64(column, F.lit(seed)) if seed else F.xxhash64(column), F.lit(folds))


def forest(setting: Setting, trees: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="x", weightCol="_weight", numTrees=trees, maxDepth=DEEPEST if setting.depth is None else setting.depth, seed=seed)


def weighted(rows: DataFrame, setting: Setting) -> DataFrame:
    return rows.withColumn("_weight", F.when(F.col("label") == 1, F.lit(setting.target_weight)).otherwise(F.lit(1.0)))


def grid_accuracy(learn: DataFrame, grid: list[Setting], folds: int = 3, seed: int = 1, trees: int = CHOICE_TREES) -> dict[Setting, float]:
    """Held-out accuracy of each setting on ``learn(query_id, x, label)``, over folds by query; settings run side by side."""
    n = learn.count()
    part = learn.where(F.pmod(F.xxhash64("query_id", F.lit(29)), F.lit(1 << 20)) < int(min(1.0, CHOICE_ROWS / max(n, 1)) * (1 << 20))) if n > CHOICE_ROWS else learn
    rows = cut(part.select("x", "label", fold_of("query_id", folds, 31).alias("_inner")).coalesce(1))  # about ``CHOICE_ROWS`` rows
    counts = {(r["_inner"], r["label"]): r["count"] for r in rows.groupBy("_inner", "label").count().collect()}
    total = sum(counts.values())

    def right(k: int, setting: Setting) -> int:
        if len({label for inner, label in counts if inner != k}) < 2:
            return 0
        own = weighted(rows.where(F.col("_inner") != k), setting)
        out = forest(setting, trees, seed).fit(own).transform(rows.where(F.col("_inner") == k))
        return out.where("prediction = label").count()

    distinct = {(s.depth, s.target_weight): s for s in reversed(grid)}
    jobs = [(k, s) for s in distinct.values() for k in range(folds)]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # of Spark jobs
        each = [inheritable_thread_target(learn.sparkSession)(partial(right, *job)) for job in jobs]  # its own copy of the session's properties
        hits = list(pool.map(lambda job: job(), each))
    share: dict[tuple, float] = {}
    for (_, s), c in zip(jobs, hits):
        share[s.depth, s.target_weight] = share.get((s.depth, s.target_weight), 0.0) + c / max(total, 1)
    return {s: share[s.depth, s.target_weight] for s in grid}


def choose(learn: DataFrame, grid: list[Setting] = GRID, seed: int = 1) -> Setting:
    """The setting of highest held-out accuracy, the first in grid order among equals."""
    found = grid_accuracy(learn, grid, seed=seed)
    return max(grid, key=lambda s: (round(found[s], 12), -grid.index(s)))


def rescore(ssms: DataFrame, features: list[str], model: str = "rf", train_fdr: float = 0.01, folds: int = 3, rounds: int = 3, direction: str = "cosine", seed: int = 1, grid: list[Setting] = GRID) -> DataFrame:
    """``ssms(ssm_id, query_id, is_decoy, features...)`` with ``score`` from models that did not see the query.

    Positives are targets below ``train_fdr`` by the score so far (all targets if there are too few), negatives are decoys. A fold
    whose learning rows have one class only keeps the score of ``direction``.
    """
    if model == "none":
        return ssms.withColumn("score", F.col(direction).cast("double"))
    x = cut(prepare(ssms, features).withColumn("_fold", fold_of("query_id", folds)))
    scored, chosen = x.withColumn("score", F.col(direction).cast("double")), {}
    for _ in range(rounds):
        passed = q_values(scored.select("ssm_id", "score", "is_decoy", "_fold"), groups=["_fold"]).select("ssm_id", (F.col("q") <= train_fdr).alias("_pass"))
        labelled = cut(scored.join(passed, "ssm_id").select("query_id", "x", "_fold", "is_decoy", "_pass"))
        enough = labelled.where("_pass").count() >= 20
        labelled = labelled.where(F.col("is_decoy") | (F.col("_pass") if enough else ~F.col("is_decoy"))).withColumn("label", (~F.col("is_decoy")).cast("double"))
        parts = []
        for k in range(folds):
            learn, rest = labelled.where(F.col("_fold") != k), x.where(F.col("_fold") == k)
            if learn.select("label").distinct().count() < 2:
                parts.append(rest.withColumn("score", F.col(direction).cast("double")))
                continue
            if model == "svm":
                fitted = LinearSVC(featuresCol="x", maxIter=12, regParam=0.01).fit(learn)
            else:
                if k not in chosen:
                    chosen[k] = choose(learn, grid, seed)
                fitted = forest(chosen[k], TREES, seed).fit(weighted(learn, chosen[k]))
            value = vector_to_array("rawPrediction" if model == "svm" else "probability")[1]
            parts.append(fitted.transform(rest).withColumn("score", value).select(*x.columns, "score"))
        scored = parts[0]
        for p in parts[1:]:
            scored = scored.unionByName(p)
        scored = cut(scored)
    return scored.drop("x", "_fold")
