"""Blocked matching, the stored index and the processed store against the plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.operators import ann, block_match, matching
from ionweave.operators.candidates import precursor_pairs
from ionweave.plans import search as plan
from ionweave.sources import versions

PEAK = "struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>"
SPECTRA = f"id string, precursor_mz double, precursor_charge int, peptide string, is_decoy boolean, peaks array<{PEAK}>"


def spectra(rng, n, name):
    peaks = lambda: sorted(((float(m), float(i), None, None, int(z) or None) for m, i, z in zip(rng.uniform(100, 160, 15).round(1), rng.integers(1, 6, 15), rng.integers(0, 3, 15))), key=lambda p: p[:2])
    return [(f"{name}{k:03d}", 500.0 + float(rng.uniform(-9, 9)), int(rng.integers(2, 4)), "PEP", bool(rng.integers(0, 2)), peaks() if k % 9 else []) for k in range(n)]


@pytest.mark.parametrize("shift", [False, True])
@pytest.mark.parametrize("annotated", [False, True])
def test_blocks_equal_pairs(spark, monkeypatch, shift, annotated):
    rng = np.random.default_rng(12)
    both = spectra(rng, 60, "q"), spectra(rng, 150, "l") + [("l999", 500.0, 2, "PEP", False, spectra(rng, 2, "x")[1][5])] * 1
    q, lib = (spark.createDataFrame(rows, SPECTRA) for rows in both)
    monkeypatch.setattr(block_match, "WORK", 2000)
    for tolerance, mode in ((4.0, "Da"), (3000.0, "ppm")):
        pairs = matching.with_spectra(precursor_pairs(q, lib, tolerance, mode), q, lib)
        columns = ["query_id", "library_id", "charge", "dot", "num_candidates", "matches"]
        want = sorted(map(tuple, matching.best_match(matching.align(pairs, 0.55, shift, annotated)).select(columns).collect()), key=str)
        for part in (block_match.PART, 20):  # 20: crowded blocks are split
            best = block_match.best_in_window(q, lib, tolerance, mode, 0.55, shift, annotated, part=part)
            assert sorted(map(tuple, best.select(columns).collect()), key=str) == want
    row = best.first()
    assert [tuple(p) for p in row["l_peaks"]] == next(list(r[5]) for r in both[1] if r[0] == row["library_id"])


def test_blocks_take_neighbours(spark):
    rng = np.random.default_rng(3)
    q, lib = spectra(rng, 30, "q"), spectra(rng, 80, "l")
    near = [(r[0], r[2], [x[0] for x in lib if rng.random() < 0.3]) for r in q if r[2] == 2]
    allowed = {(a, z): set(ids) for a, z, ids in near}
    frames = spark.createDataFrame(q, SPECTRA), spark.createDataFrame(lib, SPECTRA)
    got = block_match.best_in_window(*frames, 6.0, "Da", 0.55, True, near=spark.createDataFrame(near, "query_id string, charge int, near array<string>"))
    counts = {r["query_id"]: r["num_candidates"] for r in got.collect()}
    want = {a[0]: sum(a[2] == b[2] and abs(a[1] - b[1]) * a[2] <= 6.0 and (a[2] == 3 or b[0] in allowed[a[0], 2]) for b in lib) for a in q}
    assert counts == {k: n for k, n in want.items() if n}


def test_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(7, 33))
    rows = [(f"v{k:04d}", [float(x) for x in v[k % 7]], k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "id string, vec array<double>, label int").repartition(6)
    q = df.where("id in ('v0003', 'v0010', 'v2999')")
    got = {}
    for r in ann.exact_neighbours(q, df, 12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["library_id"])
    assert got == {a: [f"v{k:04d}" for k in range(3000) if k % 7 == int(a[1:]) % 7][:12] for a in got} and len(got) == 3
    ranks = {r[0]: r[1] for r in ann.rank_of_other(q, df).collect()}
    order = {a: sorted(range(3000), key=lambda k: (-round(float(v[k % 7] @ v[int(a[1:]) % 7]), 9), k)) for a in got}
    assert ranks == {a: 1 + next(i for i, k in enumerate(order[a]) if k % 3 != int(a[1:]) % 3) for a in got}


def test_processed_store(spark, tmp_path):
    rng = np.random.default_rng(8)
    lib = spark.createDataFrame(spectra(rng, 90, "l"), SPECTRA)
    reads = []

    def library():
        reads.append(1)
        return lib

    base = dict(precursor_tolerance_mass=1.0, precursor_tolerance_mode="Da", fragment_mz_tolerance=0.5, precursor_tolerance_mass_open=6.0, precursor_tolerance_mode_open="Da", min_peaks=5, min_mz_range=10.0, num_list=4, num_probe=4, hash_len=50, model="none", fdr=0.5, fdr_min_group_size=2)
    cfg, path = SearchConfig(**base), str(tmp_path / "store")
    first = plan.prepare(library, cfg, path, "a", spark)
    again = plan.prepare(library, cfg, path, "a", spark)
    assert len(reads) == 1 and again.index == first.index and again.spectra.inputFiles() == first.spectra.inputFiles()
    other = plan.prepare(library, SearchConfig(**base | {"num_list": 3, "num_probe": 3}), path, "a", spark)  # a new layout: the index alone
    assert len(reads) == 1 and other.index != first.index
    scaled = plan.prepare(library, SearchConfig(**base | {"scaling": "root"}), path, "a", spark)
    assert len(reads) == 2 and scaled.spectra.inputFiles() != first.spectra.inputFiles()
    plan.prepare(library, SearchConfig(**base | {"scaling": "root"}), path, "b", spark)  # a changed source
    assert len(reads) == 3
    found = plan.search(lib, plan.prepare(library, cfg, path, "b", spark), cfg)
    whole = plan.search(lib, lib, SearchConfig(**base | {"mode": "bf"}))
    key = lambda df: sorted((r["query_id"], r["level"], r["library_id"]) for r in df.collect())
    assert key(found) == key(whole)  # all cells are probed


def test_failed_build_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "v")
    a = versions.build_or_open(spark, path, {"k": 1}, lambda at: spark.range(3).write.parquet(at))

    def broken(at):
        spark.range(5).write.parquet(at)
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        versions.build_or_open(spark, path, {"k": 2}, broken)
    assert versions.current(spark, path) == (a, {"k": 1}) and spark.read.parquet(a).count() == 3
    b = versions.build_or_open(spark, path, {"k": 2}, lambda at: spark.range(4).write.parquet(at))
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 4  # readers of the old one go on
    c = versions.build_or_open(spark, path, {"k": 3}, lambda at: spark.range(6).write.parquet(at))
    assert versions.current(spark, path)[0] == c and not (tmp_path / "v" / a.rsplit("/", 1)[-1]).exists()


@pytest.mark.parametrize("shift", [False, True])
def test_all_pairs_equal_joined_pairs(spark, monkeypatch, shift):
    rng = np.random.default_rng(21)
    q, lib = (spark.createDataFrame(spectra(rng, n, name), SPECTRA) for n, name in ((40, "q"), (120, "l")))
    monkeypatch.setattr(block_match, "WORK", 50)
    pairs = matching.with_spectra(precursor_pairs(q, lib, 4.0, "Da"), q, lib)
    moves = matching.shifts(F.col("q_precursor_mz"), F.col("l_precursor_mz"), F.col("charge"), 0.9, shift)
    each = pairs.select("query_id", "library_id", F.explode(matching.peak_pairs(F.col("q_peaks"), F.col("l_peaks"), moves, 0.55)).alias("p"))
    want = each.groupBy("query_id", "library_id").agg(F.count("*"), F.sum(F.col("p.q") * 1000 + F.col("p.l")), F.round(F.sum("p.w"), 6))
    for part in (block_match.PART, 20):
        got = block_match.all_in_window(q, lib, 4.0, "Da", 0.55, shift, least_shift=0.9, part=part).withColumn("w", F.round("w", 6))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = matching.align(pairs, 0.55, shift).select("query_id", "library_id", F.explode("matches").alias("m")).select("query_id", "library_id", "m.q", "m.l", "m.w")
    assert sorted(map(tuple, block_match.all_in_window(q, lib, 4.0, "Da", 0.55, shift, matches=True).collect())) == sorted(map(tuple, want.collect()))


def test_edges_go_by_peaks_that_meet(monkeypatch):
    """Pairs of spectra without a common peak cost no look-up of their own."""
    import pyarrow as pa

    peaks = lambda at: pa.array([[{"mz": at + k, "intensity": 1.0} for k in range(30)]] * 400)
    table = lambda at: pa.table({"id": list(range(400)), "mz": [500.0] * 400, "charge": pa.array([2] * 400, pa.int32()), "peaks": peaks(at), "is_decoy": [False] * 400, "peptide": ["P"] * 400})
    monkeypatch.setattr(block_match, "pair_edges", lambda *_: 1 / 0)
    kernel = block_match.BestMatches(table(100.0), 1.0, "Da", 0.1, True, False, False)
    kernel.add(table(900.0).combine_chunks().to_batches()[0])
    out = next(kernel.result())
    assert set(out.column("library_id").to_pylist()) == {0} and set(out.column("num_candidates").to_pylist()) == {400}


def test_greedy_edges_hold_no_more_than_their_edges():
    import tracemalloc

    from ionweave.operators.block_match import greedy_edges

    n, r = 20_000, np.random.default_rng(1)
    tracemalloc.start()
    pair, i, j, w = greedy_edges(np.arange(n), r.integers(0, 1000, n), r.integers(0, 1000, n), r.random(n))  # an edge a pair, of spectra with 1000 peaks
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pair) == n and peak < 20_000_000


@pytest.mark.parametrize(("shift", "annotated"), [(False, False), (True, False), (True, True)])
def test_copies_are_aligned_once(spark, monkeypatch, shift, annotated):
    """Copies of spectra under other ids give the results of all pairs, and only distinct ones are dealt to blocks."""
    rng = np.random.default_rng(31)
    some = spectra(rng, 60, "l") + [("m000", 500.0, 2, "PEP", False, [])]
    rows = [(f"{r[0]}{chr(97 + c)}", *r[1:3], f"P{c}", c % 2 == 1, r[5]) for c in range(4) for r in some]
    lib = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], SPECTRA).repartition(5)
    q = lib.where("id like '%4a' or id like '%7a' or id like '%7b' or id like '%9c' or id like 'm%'")
    dealt, made = [], block_match.blocks.meet
    monkeypatch.setattr(block_match.blocks, "meet", lambda queries, lib, *rest: (dealt.append(lib.select("id").distinct().count()), made(queries, lib, *rest))[1])
    for same in (False, True):
        pairs = matching.with_spectra(precursor_pairs(q, lib, 4.0, "Da"), q, lib)
        pairs = pairs.where("query_id != library_id") if same else pairs
        columns = ["query_id", "library_id", "charge", "dot", "num_candidates", "matches"]
        want = matching.best_match(matching.align(pairs, 0.55, shift, annotated)).join(lib.selectExpr("id library_id", "is_decoy", "peptide"), "library_id").select(columns + ["is_decoy", "peptide"])
        got = block_match.best_in_window(q, lib, 4.0, "Da", 0.55, shift, annotated, exclude_same=same).select(columns + ["is_decoy", "peptide"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert dealt == [61, 61]
