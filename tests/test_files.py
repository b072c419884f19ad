"""Ranged and ordered files: several tasks a file, reads by offset, parts joined in order."""

import os

import numpy as np
from pyspark.sql import functions as F

from ionweave.plans import catalogue
from ionweave.sources import binary, export, mztab, registry

PEAK = "struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>"
SPECTRA = f"id string, precursor_mz double, precursor_charge int, retention_time double, peptide string, is_decoy boolean, peaks array<{PEAK}>"


def made(n=120):
    rng = np.random.default_rng(6)
    return [(str(k), 400 + k / 7, 2 + k % 3, k + 0.25, "PEPK", k % 4 == 0, sorted((float(m), float(i), "b" if j % 2 else None, j + 1 if j % 2 else None, 1 if j % 2 else None) for j, (m, i) in enumerate(zip(rng.uniform(100, 900, 40), rng.uniform(0.1, 9, 40))))) for k in range(n)]


def test_ranges_of_one_file(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame(rows, SPECTRA).coalesce(1).sortWithinPartitions(F.col("id").cast("int"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for name, write in ((".mzML", export.write_mzml), (".mzXML", export.write_mzxml)):
        write(df, str(tmp_path / f"s{name}"))
        assert sum(f.endswith(".txt") for f in os.listdir(tmp_path / f"s{name}")) == 1
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = registry.read_queries(spark, str(tmp_path / f"s{name}"))
            tasks = got.rdd.getNumPartitions()
            many = got.orderBy("source_index").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        one = registry.read_queries(spark, str(tmp_path / f"s{name}")).orderBy("source_index").collect()
        assert many == one and tasks > 1 and [r["source_index"] for r in many] == list(range(120)) and [r["id"] for r in many] == [r[0] for r in rows]
        assert [[(p["mz"], p["intensity"]) for p in r["peaks"]] for r in many] == [[p[:2] for p in r[6]] for r in rows]


def test_nested_scans(spark, tmp_path):
    scan = lambda n, level, inner="": f'<scan num="{n}" msLevel="{level}" retentionTime="PT1S"><precursorMz precursorCharge="2">5.5</precursorMz><peaks precision="32"></peaks>{inner}</scan>'
    (tmp_path / "n.mzXML").write_text("<mzXML><msRun>" + scan(1, 1, scan(2, 2) + scan(3, 2)) + scan(4, 1) + scan(5, 2) + "</msRun></mzXML>")
    rows = registry.read_queries(spark, str(tmp_path / "n.mzXML")).orderBy("source_index").collect()
    assert [(r["id"], r["source_index"], r["precursor_mz"]) for r in rows] == [("2", 1, 5.5), ("3", 2, 5.5), ("5", 4, 5.5)]


def test_splib_by_offset(spark, tmp_path):
    rows = made(300)
    df = spark.createDataFrame(rows, SPECTRA).coalesce(2)
    path = str(tmp_path / "lib.splib")
    export.write_splib(df, path)
    files = [str(tmp_path / "lib.splib" / f) for f in os.listdir(path)]
    size = sum(os.path.getsize(f) for f in files)
    assert len(files) == 2
    whole = {r["id"]: r for r in registry.read_library(spark, path).collect()}
    assert {k: (r["precursor_mz"], r["precursor_charge"], r["peptide"], r["is_decoy"]) for k, r in whole.items()} == {r[0]: (r[1], r[2], r[4], r[5]) for r in rows}
    assert all([(p["mz"], p["intensity"], p["ion_type"], p["ion_index"]) for p in whole[r[0]]["peaks"]] == [p[:4] for p in r[6]] for r in rows)
    assert [tuple(x) for x in binary.scan_splib(files[0])] == [tuple(x) for x in binary.scan_splib(files[0], window=50)]  # a window shorter than a spectrum
    offsets = binary.splib_offsets(spark, path)
    assert offsets.count() == 300 and offsets.agg(F.sum("size")).first()[0] < size
    few = binary.read_splib_ids(spark, path, spark.createDataFrame([(7,), (251,), (9999,)], "id int"))
    got = few.collect()
    assert {r["id"]: r["peaks"] for r in got} == {k: whole[k]["peaks"] for k in ("7", "251")}
    assert 0 < sum(r["bytes"] for r in got) < size / 20  # no more than the two spectra
    assert sum(r["bytes"] for r in binary.read_splib_at(offsets, 4).collect()) <= size
    kept = binary.splib_offsets(spark, path).inputFiles()
    assert kept == offsets.inputFiles()  # scanned once
    export.write_splib(spark.createDataFrame(rows[:10], SPECTRA).coalesce(2), path)
    assert binary.splib_offsets(spark, path).count() == 10  # a changed file is scanned again


def test_strict_annotations():
    good = {"b2/0.1": ("b", 2, 1), "y7^2/0.02": ("y", 7, 2), "a11": ("a", 11, 1)}
    assert {n: binary.strict_annotation(n) for n in good} == good
    assert not any(binary.strict_annotation(n) for n in ("?", "", "b2-18/0.1", "y7i/0.2", "p", "y", "IRA/0.1", "b2^/0.1", "x3/0.1", "b2*/0.1"))


def test_joined_parts_keep_order(spark, tmp_path):
    df = spark.range(5000).select(F.format_string("%05d line é", "id").alias("value")).repartition(7)
    df.orderBy("value").write.text(str(tmp_path / "parts"))
    mztab.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "one.txt"))
    assert (tmp_path / "one.txt").read_text() == "".join(f"{k:05d} line é\n" for k in range(5000)) and not (tmp_path / "parts").exists()


def test_queries_are_registered():
    assert {"source_mgf", "source_mzml", "source_mzxml", "source_sptxt", "source_splib", "source_splib_ids", "source_proteins", "mztab_round_trip", "processed_store"} <= set(catalogue.ORACLE)
