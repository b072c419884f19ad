"""Mass groups, rank summaries, prediction batches and SQL functions against plain definitions."""

import math

import numpy as np
import pandas as pd
import pytest

from ionweave.config import SearchConfig
from ionweave.functions import sql
from ionweave.operators import analysis
from ionweave.sources import prediction, registry


def sequential(rows, tolerance, unit):
    """The definition: the best match left takes all within the tolerance."""
    left, leader = sorted(rows, key=lambda r: (-r[2], r[0])), {}
    while left:
        top = left[0]
        by = 1.0 if unit == "Da" else max(abs(top[1]), 1e-12) * 1e-6
        taken = [r for r in left if abs(r[1] - top[1]) / by <= tolerance]
        leader |= {r[0]: top[0] for r in taken}
        left = [r for r in left if r[0] not in leader]
    return leader


@pytest.mark.parametrize(("unit", "tolerance", "spread"), [("Da", 0.05, 0.02), ("Da", 0.5, 30.0), ("ppm", 20.0, 0.004), ("ppm", 3e5, 3.0)])
def test_mass_groups(spark, unit, tolerance, spread):
    rng = np.random.default_rng(7)
    rows = []
    for part in range(3):
        centres = np.concatenate([rng.uniform(-200, 200, 12), [0.0, 1e-10, -1e-10]])
        masses = (rng.choice(centres, 120) + rng.choice([0, 0, 1], 120) * rng.normal(0, spread, 120)).round(3)
        rows += [(part * 1000 + k, float(m), float(s), part) for k, (m, s) in enumerate(zip(masses, rng.integers(0, 30, 120)))]
    df = spark.createDataFrame([*rows, (9999, None, 1.0, 1)], "id int, mass_diff double, score double, part int")
    got = {r["id"]: r["leader"] for r in analysis.greedy_groups(df, tolerance, unit).collect()}
    want = {k: v for p in range(3) for k, v in sequential([r for r in rows if r[3] == p], tolerance, unit).items()}
    assert got == want | {9999: None}


def test_runs_are_apart(spark):
    """No task sees beyond a run: a chain stays together, far masses don't."""
    rows = [(k, 0.9 * k if k < 50 else 1000.0 + 5 * k, float(k % 7), 0) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, mass_diff double, score double, part int")
    sizes = []
    inner = analysis.resolve
    assert {r["id"]: r["leader"] for r in analysis.greedy_groups(df, 1.0).collect()} == sequential(rows, 1.0, "Da")
    for at, n in ((0, 50), (50, 1)):  # what one call gets
        mass = np.array([r[1] for r in rows[at : at + n]])
        sizes.append(len(inner(mass, np.arange(n), 1.0, "Da")))
    assert sizes == [50, 1]
    with pytest.raises(ValueError):
        analysis.greedy_groups(df, 6e5, "ppm")


def test_ranks(spark):
    ranks = [1, 1, 2, 3, 10, 40, 100, 100, 700, 1000]
    df = spark.createDataFrame([(r,) for r in ranks] + [(None,)], "rank int")
    got = {r["share"]: r["k"] for r in analysis.rank_thresholds(df, "rank", [0.2, 0.25, 0.9, 0.99]).collect()}
    assert got == {0.2: 1, 0.25: 2, 0.9: 700, 0.99: 1000}
    bins = analysis.rank_bins(df, "rank", 3).orderBy("bin").collect()
    counts, edges = np.histogram(ranks, np.logspace(0, 3, 4))
    assert [r["n"] for r in bins] == counts.tolist() and [r["low"] for r in bins] == pytest.approx(edges[:-1].tolist())
    assert [r["share"] for r in bins] == pytest.approx((np.cumsum(counts) / 10).tolist())
    one = analysis.rank_bins(spark.createDataFrame([(5,), (5,)], "rank int"), "rank").collect()
    assert [(r["bin"], r["n"], r["share"]) for r in one] == [(0, 2, 1.0)]


class Flaky:
    """Fails every other call, and leaves one peptide out; intensities depend on the energy."""

    def __init__(self, folder, most):
        self.folder, self.most = folder, most

    def __call__(self, batch):
        import os
        import uuid

        assert len(batch) <= self.most
        key = "".join(batch["peptide"])[:40] + str(batch["energy"][0])
        mark = f"{self.folder}/{key}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("try again")
        open(f"{mark}.{uuid.uuid4().hex}", "w").close()
        return prediction.ladder(batch[batch["peptide"] != "LACKINGK"])


def test_prediction_batches(spark, tmp_path):
    rows = [("PEPTIDEK", z, e) for z in (2, 3) for e in (20, 35)] + [("LACKINGK", 2, 20)] + [(f"PEP{c}K", 2, 20) for c in "ACDEFGH"]
    df = spark.createDataFrame(rows, "peptide string, precursor_charge int, energy int").coalesce(1)
    got = {r["id"]: r for r in prediction.predict_spectra(df, Flaky(str(tmp_path), 3), batch_size=3, tries=2, wait=0.01).collect()}
    assert set(got) == {f"{p}/{z}/{e}" for p, z, e in rows if p != "LACKINGK"}
    peaks = {e: got[f"PEPTIDEK/2/{e}"]["peaks"] for e in (20, 35)}
    assert all(len(p) == 14 and [x["mz"] for x in p] == sorted(x["mz"] for x in p) for p in peaks.values())
    for e, p in peaks.items():
        assert all(x["intensity"] == pytest.approx(math.exp(-e * x["ion_index"] / 1000)) and x["ion_charge"] == 1 and x["ion_type"] in "by" for x in p)
    with pytest.raises(Exception, match="try again"):
        (tmp_path / "other").mkdir()
        prediction.predict_spectra(df, Flaky(str(tmp_path / "other"), 3), batch_size=3, tries=1).collect()


def test_regrouped():
    rows = [("A", 2, 30, 5.0, 1.0, "y1+1"), ("A", 2, 30, 3.0, 0.5, "b1+1"), ("A", 2, 35, 3.0, 0.0, "b1+1"), ("B", 2, 30, 1.0, 0.1, "b1+1")]
    out = prediction.regrouped(pd.DataFrame(rows, columns=[*prediction.KEYS, "mz", "intensity", "annotation"]))
    assert out.to_dict("records") == [{"peptide": "A", "precursor_charge": 2, "energy": 30, "mz": [3.0, 5.0], "intensity": [0.5, 1.0], "annotation": ["b1+1", "y1+1"]}, {"peptide": "B", "precursor_charge": 2, "energy": 30, "mz": [1.0], "intensity": [0.1], "annotation": ["b1+1"]}]


def test_prediction_settings(spark, tmp_path):
    cfg = SearchConfig(20, "ppm", 0.02, min_precursor_charge=3, max_precursor_charge=4, collision_energies=(25, 30), missed_cleavages=0)
    assert SearchConfig.from_pairs({k: str(v) for k, v in cfg.settings().items()}) == cfg
    (tmp_path / "p.fasta").write_text(">a\nLESLIEKPEPTIDEKHPYLEDR\n")
    ids = {r["id"] for r in registry.read_library(spark, str(tmp_path / "p.fasta"), cfg).collect()}
    assert ids == {f"{p}/{z}/{e}" for p in ("LESLIEKPEPTIDEK", "HPYLEDR") for z in (3, 4) for e in (25, 30)}
    for wrong in ({"min_precursor_charge": 5}, {"protease": "none"}, {"collision_energies": ()}):
        with pytest.raises(ValueError):
            SearchConfig(20, "ppm", 0.02, **wrong)


def test_sql_functions(spark):
    names = sql.register(spark)
    spark.createDataFrame([([(1.0, 0.6), (2.0, 0.8)], [(1.5, 1.0)], [(1, 0, 0.8)])], f"q_peaks {sql.PEAKS.replace(': ', ':')}, l_peaks {sql.PEAKS.replace(': ', ':')}, matches {sql.MATCHES.replace(': ', ':')}").createOrReplaceTempView("found")
    row = spark.sql("SELECT " + ", ".join(f"{n}(q_peaks, l_peaks, matches) AS {n}" for n in names) + " FROM found").first()
    want = {"cosine": 0.8, "n_matched": 1, "frac_n_query": 0.5, "frac_n_library": 1, "frac_intensity_query": 0.8 / 1.4, "mse_mz": 0.25, "manhattan": 0.8, "euclidean": math.sqrt(0.04 + 0.36), "chebyshev": 0.6}
    assert {k: row[f"similarity_{k}"] for k in want} == pytest.approx(want)
