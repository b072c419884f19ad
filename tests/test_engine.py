"""Operators, sources and the search on small literal inputs."""

import base64
import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.functions import sequences as seq
from ionweave.operators import ann, decoy, fdr, matching, preprocess, vectorize
from ionweave.operators.candidates import precursor_pairs
from ionweave.plans.search import search
from ionweave.sources import mztab, registry, text

PEAK = "struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_q_values_golden(spark):
    decoys = {3, 4, 8, 9, 11}
    rows = [(i, 1 - i / 100, i in decoys) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, score double, is_decoy boolean")
    want = [1 / 3, 1 / 3, 1 / 3, None, None, 1 / 2, 1 / 2, 1 / 2, None, None, 5 / 7, None]
    for method in (fdr.q_values, fdr.q_values_by_window):
        got = [r["q"] for r in method(df).orderBy("i").collect()]
        assert [None if g is None else round(g, 9) for g in got] == [None if w is None else round(w, 9) for w in want]


def test_find_peaks():
    x = np.array([0, 2, 1, 3, 3, 0, 1, 0])
    assert fdr.find_peaks(x) == [(1, 0, 2), (3, 0, 5), (6, 5, 7)]
    assert fdr.find_peaks(np.array([3, 1, 1])) == []


def test_shift_groups(spark):
    rows = [(i, d) for i, d in enumerate([0.0051] * 30 + [0.1251] * 5 + [15.9951] * 20 + [40.3])]
    got = fdr.shift_groups(spark.createDataFrame(rows, "id int, mass_diff double"), least=10).orderBy("id").collect()
    groups = [r["mass_group"] for r in got]
    assert len(set(groups[:30])) == 1 and groups[0] >= 0 and set(groups[30:35]) == {-1}
    assert len(set(groups[35:55])) == 1 and groups[35] not in (-1, groups[0]) and groups[55] == -1


def test_slots():
    assert [vectorize.slot_of(b, 800) for b in (0, 42, 123, 1234, 49975)] == [281, 444, 719, 781, 385]
    n, start, end = vectorize.dimensions(11, 2010, 0.04)
    assert (n, round(start, 6), round(end, 6)) == (49976, 10.96, 2010.0)


def test_preprocess_drops_invalid(spark):
    cfg = SearchConfig(20, "ppm", 0.02)
    peaks = [(100.0 + 30 * i, float(i + 1), None, None, None) for i in range(12)]
    rows = [("a", 500.0, 2, peaks), ("b", 500.0, 2, peaks[:5]), ("c", 500.0, 2, []), ("d", 500.0, None, peaks)]
    df = spark.createDataFrame(rows, f"id string, precursor_mz double, precursor_charge int, peaks array<{PEAK}>")
    got = {r["id"]: r["peaks"] for r in preprocess.process(df, cfg, False).collect()}
    assert set(got) == {"a", "d"}
    assert sum(p["intensity"] ** 2 for p in got["a"]) == pytest.approx(1)
    assert [p["intensity"] for p in got["a"]] == sorted(p["intensity"] for p in got["a"])
    assert sorted(r["precursor_charge"] for r in preprocess.expand_charge(df.where("id = 'd'")).collect()) == [2, 3]


def test_bands_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), float(m), int(z)) for i, (m, z) in enumerate(zip(rng.uniform(400, 420, 150), rng.integers(2, 4, 150)))]
    df = spark.createDataFrame(rows, "id string, precursor_mz double, precursor_charge int")
    for tol, mode in ((1.3, "Da"), (700.0, "ppm")):
        got = {(r[0], r[1]) for r in precursor_pairs(df, df, tol, mode).select("query_id", "library_id").collect()}
        fits = (lambda a, b, z: abs(a - b) * z <= tol) if mode == "Da" else (lambda a, b, z: abs(a - b) / b * 1e6 <= tol)
        assert got == {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and fits(a[1], b[1], a[2])}
    with pytest.raises(ValueError):
        precursor_pairs(df, df, 1, "Th")


def test_shifted_greedy_match(spark):
    q = [(100.0, 1.0, None, None, None), (210.0, 2.0, None, None, None)]
    lib = [(100.0, 1.0, None, None, None), (200.0, 3.0, "y", 2, 1)]
    df = spark.createDataFrame([("q", "l", 1, 510.0, 500.0, q, lib)], f"query_id string, library_id string, charge int, q_precursor_mz double, l_precursor_mz double, q_peaks array<{PEAK}>, l_peaks array<{PEAK}>")
    assert matching.align(df, 0.02, False).first()["dot"] == 1.0
    assert matching.align(df, 0.02, True).first()["dot"] == pytest.approx(1 + 6 * 2 / 3)
    assert matching.align(df, 0.02, True, annotated=True).first()["dot"] == 7.0


def test_both_alignments_agree(spark):
    rng = np.random.default_rng(8)
    peaks = lambda: sorted(((float(m), float(i), None, None, int(z) or None) for m, i, z in zip(rng.uniform(100, 160, 20).round(1), rng.integers(1, 6, 20), rng.integers(0, 3, 20))), key=lambda p: p[:2])
    rows = [(str(k), "l", 2, 500.0 + float(rng.uniform(-9, 9)), 500.0, peaks(), peaks()) for k in range(25)]
    df = spark.createDataFrame(rows, f"query_id string, library_id string, charge int, q_precursor_mz double, l_precursor_mz double, q_peaks array<{PEAK}>, l_peaks array<{PEAK}>")
    for shift in (False, True):
        for annotated in (False, True):
            a, b = (matching.align(df, 0.55, shift, annotated, native).orderBy("query_id").select("matches").collect() for native in (True, False))
            assert a == b


def test_index_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, vec array<double>").persist()
    q = df.where("id % 20 = 0")
    truth = ann.exact_neighbours(q, df, 5)
    want = {int(i): np.argsort(-(v @ v[i]), kind="stable")[:5].tolist() for i in range(0, 400, 20)}
    got = {}
    for r in truth.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["library_id"])
    assert got == want
    filed = df.withColumn("charge", F.lit(2)).unionByName(df.where("id < 5").withColumn("charge", F.lit(3)))
    index = ann.build_or_open(filed, str(tmp_path / "ivf"), "layout", "source", 8)
    asked = q.withColumn("charge", F.lit(2))
    assert ann.recall(index.search(asked, 5, 8), truth) == 1.0
    assert ann.recall(index.search(asked, 5, 5), truth) >= 0.8
    assert index.search(q.withColumn("charge", F.lit(3)), 5, 8).count() == 0  # too few vectors for an index
    assert [r[0] for r in index.charges().collect()] == [2]
    assert ann.build_or_open(filed, str(tmp_path / "ivf"), "layout", "source", 8).path == index.path
    assert ann.build_or_open(filed, str(tmp_path / "ivf"), "other", "source", 8).path != index.path
    one = index.search(asked.where("id = 0"), 5, 1).select("library_id")  # reads one cell's folder
    lots = {r["id"]: r["lot"] for r in index.vectors().where("charge = 2").select("id", "lot").collect()}
    read = {lots[r[0]] for r in one.collect()}
    assert len(read) == 1


def test_decoys():
    rows = decoy.residues("YYVC[Carbamidomethyl]TAPHC[Carbamidomethyl]GHR")
    plain = "".join(a for a, _ in rows)
    shuffled, origin = decoy.shuffle(plain)
    assert Counter(shuffled) == Counter(plain) and shuffled != plain and shuffled[-1] == "R" and shuffled[6] == "P"
    assert shuffled == "".join(plain[i] for i in origin) and decoy.shuffle(plain) == (shuffled, origin)
    assert decoy.shuffle("AAAAK")[0] == "AAAAK" and decoy.shuffle("K")[0] == "K"
    peaks = sorted((mz, float(i)) for i, mz in enumerate(decoy.fragments([m for _, m in rows], 4).values()))
    _, moved = decoy.reposition("YYVC[Carbamidomethyl]TAPHC[Carbamidomethyl]GHR", 4, peaks, 10)
    assert len(moved) == len(peaks) and sorted(i for _, i in moved) == sorted(i for _, i in peaks) and moved == sorted(moved)


def test_decoys_move_losses():
    """A peak of a fragment less water goes where the moved fragment less water lies; a whole fragment wins over a loss."""
    rows = decoy.residues("HPYLEDR")
    old = decoy.fragments([m for _, m in rows], 2, decoy.LOSSES)
    _, origin = decoy.shuffle("HPYLEDR")
    new = decoy.fragments([rows[i][1] for i in origin], 2, decoy.LOSSES)
    for key in (("b", 4, 1, "H2O"), ("y", 3, 1, "NH3"), ("b", 5, 1, "")):
        (mz, _), = decoy.reposition("HPYLEDR", 2, [(old[key] + 1e-4, 1.0)], 5)[1]
        assert mz == pytest.approx(new[key] + 1e-4, abs=1e-6)
    assert old["a", 3, 1, ""] == pytest.approx(old["b", 3, 1, "CO"], abs=1e-4) and len(old) > 13 * 8


def test_marks(spark):
    marks = [1.0, 2.5, 2.75, 9.0, 9.5]
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.6, 9.5, 10.0)], "x double")
    for k in range(6):
        got = [r[0] for r in df.select(fdr.marks_above(F.col("x"), marks[:k])).collect()]
        assert got == [sum(m > r[0] for m in marks[:k]) for r in df.collect()]


def test_sequences(spark):
    assert one(spark, seq.mgf_to_proforma(F.lit("PEP+15.995TIDE"))) == "PEP[+15.995]TIDE"
    assert one(spark, seq.mgf_to_proforma(F.lit("+42.011PEPTIDE"))) == "[+42.011]-PEPTIDE"
    assert one(spark, seq.mgf_to_proforma(F.lit("+43.006-17.027PEPTIDE"))) == "[+43.006]?[-17.027]-PEPTIDE"
    assert one(spark, seq.sptxt_to_proforma(F.lit("MEC"), F.lit("2/0,M,Oxidation/2,C,Carbamidomethyl"))) == "M[Oxidation]EC[Carbamidomethyl]"
    assert one(spark, seq.sptxt_to_proforma(F.lit("MEC"), F.lit(None).cast("string"))) == "MEC"
    note = lambda t: one(spark, seq.fragment_annotation(F.lit(t)))
    assert tuple(note("y7^2/0.02")) == ("y", 7, 2) and tuple(note("b3")) == ("b", 3, 1) and tuple(note("y2+2")) == ("y", 2, 2)
    assert note("y7-18/0.1") is None and note("?") is None
    assert one(spark, seq.mass(F.lit("PEPTIDE"))) == pytest.approx(799.35997, abs=1e-4)
    assert one(spark, seq.edit_distance(F.lit("abc"), F.lit(None).cast("string"))) == math.inf
    ids = spark.createDataFrame([("a10",), ("a9",), ("B2",)], "id string")
    assert [r[0] for r in ids.orderBy(seq.natural_key(F.col("id"))).collect()] == ["a9", "a10", "B2"]
    proteins = spark.createDataFrame([("AAKCCRPDDKEEEK",), ("AAK",)], "sequence string")
    assert {r[0] for r in seq.cleave(proteins, shortest=3).collect()} == {"AAK", "CCRPDDK", "EEEK"}
    assert {r[0] for r in seq.cleave(proteins, missed=1, shortest=3).collect()} == {"AAK", "CCRPDDK", "EEEK", "AAKCCRPDDK", "CCRPDDKEEEK"}


def ladder(peptide):
    m = [seq.MONOISOTOPIC[c] for c in peptide]
    b = [sum(m[:i]) + seq.PROTON for i in range(1, len(m))]
    return sorted(b + [sum(m[i:]) + seq.WATER + seq.PROTON for i in range(1, len(m))])


PEPTIDES = ["LESLIEK", "PEPTIDEK", "HPYLEDR"]


def test_mgf_search_and_mztab(spark, tmp_path):
    block = lambda p, k, z: f"BEGIN IONS\nTITLE={p}/{k}\nSEQ={p}\nPEPMASS={(sum(seq.MONOISOTOPIC[c] for c in p) + seq.WATER) / 2 + seq.PROTON} 7\nCHARGE={z}+\nRTINSECONDS={k}.5\n" + "".join(f"{mz:.4f} 1.0\n" for mz in ladder(p)) + "END IONS\n\n"
    (tmp_path / "q.MGF").write_text("".join(block(p, k, 2) for k, p in enumerate(PEPTIDES)))
    df = registry.read_queries(spark, str(tmp_path / "q.MGF"))
    rows = df.orderBy("source_index").collect()
    assert [r["id"] for r in rows] == [f"{p}/{k}" for k, p in enumerate(PEPTIDES)] and [r["source_index"] for r in rows] == [1, 2, 3]
    assert rows[0]["precursor_charge"] == 2 and rows[2]["retention_time"] == 2.5 and len(rows[1]["peaks"]) == 14 and not rows[0]["is_decoy"]
    cfg = SearchConfig(20, "ppm", 0.02, min_peaks=5, min_mz_range=100, model="none", mode="bf", fdr=0.5)
    found = search(df, df, cfg).persist()
    assert {(r["query_id"], r["library_id"]) for r in found.collect()} == {(r["id"], r["id"]) for r in rows}
    assert all(r["score"] == pytest.approx(1) for r in found.collect())
    out = mztab.write(found.withColumns({"retention_time": F.lit(1.0), "source_index": F.lit(1)}), str(tmp_path / "out"), cfg, "file:///lib", "file:///q")
    back = text.read_mztab(spark, out)
    assert out.endswith(".mztab") and len(back.columns) == 22 and back.count() == 3 and dict(back.dtypes)["opt_ms_run[1]_cv_MS:1002217_decoy_peptide"] == "boolean"
    assert SearchConfig.from_pairs(text.settings_of(text.read_mztab_metadata(spark, out))) == cfg
    with pytest.raises(FileNotFoundError):
        registry.read_queries(spark, str(tmp_path / "q.txt"))


def test_command_line(spark, tmp_path):
    from ionweave.__main__ import parse, run

    (tmp_path / "c.ini").write_text("precursor_tolerance_mass = 20\nprecursor_tolerance_mode = ppm\nfragment_mz_tolerance = 0.5\nmin_peaks = 5\nfdr = 0.2\n")
    ns, cfg = parse([str(tmp_path / "p.fasta"), str(tmp_path / "q.mgf"), "out", "--config", str(tmp_path / "c.ini"), "--fragment_mz_tolerance", "0.02", "--model", "none", "--mode", "bf", "--min_mz_range", "50", "--fdr", "0.5", "--add_decoys"])
    assert (cfg.fragment_mz_tolerance, cfg.min_peaks, cfg.fdr, cfg.add_decoys, cfg.precursor_tolerance_mode) == (0.02, 5, 0.5, True, "ppm")
    with pytest.raises(SystemExit):
        parse(["a", "b", "c"])
    (tmp_path / "p.fasta").write_text(">x\nLESLIEKAEPTIDEKHPYLEDR\n")
    mz = lambda p: (sum(seq.MONOISOTOPIC[c] for c in p) + seq.WATER) / 2 + seq.PROTON
    (tmp_path / "q.mgf").write_text("".join(f"BEGIN IONS\nTITLE=s{k}\nPEPMASS={mz(p)}\n" + "".join(f"{v:.4f} 1.0\n" for v in ladder(p)) + "END IONS\n" for k, p in enumerate(["LESLIEK", "HPYLEDR"])))
    out = run(spark, ns.library, ns.queries, str(tmp_path / "res"), cfg)
    rows = {r["PSM_ID"]: r["sequence"] for r in text.read_mztab(spark, out).collect()}
    assert rows == {"s0": "LESLIEK", "s1": "HPYLEDR"}


def test_mzml_and_mzxml(spark, tmp_path):
    pack = lambda v, f: base64.b64encode(struct.pack(f, *v)).decode()
    cv = lambda n, v="", u="": f'<cvParam name="{n}" value="{v}" unitName="{u}"/>'
    spectra = ""
    for k, (p, level) in enumerate(zip(PEPTIDES, (2, 1, 2))):
        mz = ladder(p)
        arrays = f'<binaryDataArray>{cv("64-bit float")}{cv("m/z array")}<binary>{pack(mz, f"<{len(mz)}d")}</binary></binaryDataArray><binaryDataArray>{cv("32-bit float")}{cv("intensity array")}<binary>{pack([1.0] * len(mz), f"<{len(mz)}f")}</binary></binaryDataArray>'
        spectra += f'<spectrum id="controller=0 scan={17 + k}">{cv("ms level", level)}<scanList><scan>{cv("scan start time", 2, "minute")}</scan></scanList><precursorList><precursor><selectedIon>{cv("selected ion m/z", 400.5)}{cv("charge state", 2) if k else ""}</selectedIon></precursor></precursorList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
    spectra += f'<spectrum id="scan=99">{cv("ms level", 2)}</spectrum>'
    (tmp_path / "q.mzML").write_text(f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{spectra}</spectrumList></run></mzML>')
    rows = registry.read_queries(spark, str(tmp_path / "q.mzML")).orderBy("source_index").collect()
    assert [(r["id"], r["source_index"], r["precursor_charge"], r["retention_time"]) for r in rows] == [("17", 0, None, 120.0), ("19", 2, 2, 120.0)]
    assert [p["mz"] for p in rows[0]["peaks"]] == pytest.approx(ladder("LESLIEK"))
    flat = [v for mz in ladder("LESLIEK") for v in (mz, 1.0)]
    (tmp_path / "q.mzXML").write_text(f'<mzXML><msRun><scan num="1" msLevel="1"/><scan num="2" msLevel="2" retentionTime="PT3.5S"><precursorMz precursorCharge="3">400.5</precursorMz><peaks precision="64">{pack(flat, f">{len(flat)}d")}</peaks></scan></msRun></mzXML>')
    rows = registry.read_queries(spark, str(tmp_path / "q.mzXML")).collect()
    assert [(r["id"], r["source_index"], r["precursor_charge"], r["retention_time"], len(r["peaks"])) for r in rows] == [("2", 1, 3, 3.5, 12)]


def test_libraries(spark, tmp_path):
    (tmp_path / "l.sptxt").write_text("### header\n\nName: MEC/2\nPrecursorMZ: 200.5\nComment: Mods=1/0,M,Oxidation Parent=200.5\nNumPeaks: 2\n100.1\t5.0\tb1/0.01\n150.2\t7.0\t?\n\nName: PEK/3\nComment: Parent=150.25 Remark=DECOY_x\nNumPeaks: 1\n90.5\t1.0\ty1^2/0.1\n\n")
    rows = registry.read_library(spark, str(tmp_path / "l.sptxt")).orderBy("source_index").collect()
    assert [(r["id"], r["precursor_mz"], r["precursor_charge"], r["peptide"], r["is_decoy"]) for r in rows] == [("1", 200.5, 2, "M[Oxidation]EC", False), ("2", 150.25, 3, "PEK", True)]
    assert tuple(rows[0]["peaks"][0]) == (100.1, 5.0, "b", 1, 1) and rows[0]["peaks"][1]["ion_type"] is None and rows[1]["peaks"][0]["ion_charge"] == 2
    peaks = b"".join(struct.pack("<dd", mz, 1.0) + note + b"\n\n" for mz, note in ((100.5, b"b2/0.1"), (200.5, b"?")))
    (tmp_path / "l.splib").write_bytes(struct.pack("<ii", 4, 0) + b"l.splib\n" + struct.pack("<i", 1) + b"comment\n" + struct.pack("<i", 7) + b"X.PEPTIDE.Y/2\n" + struct.pack("<d", 400.7) + b"Normal\n" + struct.pack("<i", 2) + peaks + b"Mods=0 Remark=DECOY_a\n")
    r = registry.read_library(spark, str(tmp_path / "l.splib")).first()
    assert (r["id"], r["peptide"], r["precursor_charge"], r["precursor_mz"], r["is_decoy"], len(r["peaks"])) == ("7", "PEPTIDE", 2, 400.7, True, 2) and r["peaks"][0]["ion_type"] == "b"
    (tmp_path / "p.fasta").write_text(">one text\nMPEPTIDEK\nLESLIEKAAAAAAAK\n>two\nLESLIEK\n")
    lib = registry.read_library(spark, str(tmp_path / "p.fasta"))
    assert lib.count() == 6 and {r[0] for r in lib.select("peptide").distinct().collect()} == {"MPEPTIDEK", "LESLIEK", "AAAAAAAK"}
    got = lib.where("id = 'LESLIEK/2/30'").first()
    assert sorted(p["mz"] for p in got["peaks"]) == pytest.approx(ladder("LESLIEK"))
    cfg = SearchConfig(20, "ppm", 0.02)
    store = registry.build_or_open(spark, str(tmp_path / "p.fasta"), str(tmp_path / "store"), cfg)
    assert store.count() == 6 and registry.is_current(spark, str(tmp_path / "store"), cfg, "p.fasta")
    assert not registry.is_current(spark, str(tmp_path / "store"), SearchConfig(20, "ppm", 0.02, hash_len=400), "p.fasta")


def test_config():
    with pytest.raises(ValueError):
        SearchConfig(1, "Th", 0.1)
    with pytest.raises(ValueError):
        SearchConfig(1, "Da", 0.1, num_probe=512)
    assert len(SearchConfig(1, "Da", 0.1).layout_hash()) == 40
