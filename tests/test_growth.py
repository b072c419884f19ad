"""Steps whose cost has to grow no faster than their tables: results against plain definitions, and the rows that stand between steps."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionweave.operators import candidates as cand
from ionweave.operators import decoy, fdr
from ionweave.operators import preprocess as pre
from ionweave.plans import catalogue
from ionweave.sources import export, registry

SF = "/root/testdata/sf0.01"


def test_merge_of_many_peaks(spark):
    rows = [(1, [(k / 7, 1.0 + k % 3, f"n{k}") for k in range(6000)]), (2, [(1.2, 1.0, "a"), (None, 2.0, "b"), (1.4, 4.0, "c")]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, peaks array<struct<mz:double,intensity:double,note:string>>")
    got = {r["id"]: r["m"] for r in df.select("id", pre.round_and_merge(F.col("peaks"), 0).alias("m")).collect()}
    want: dict = {}
    for mz, intensity, note in rows[0][1]:
        level = round(mz + 1e-12)
        want[level] = (want[level][0] + intensity, want[level][1]) if level in want else (intensity, note)
    assert [(p["mz"], p["intensity"], p["note"]) for p in got[1]] == [(m, *want[m]) for m in sorted(want)]
    assert sorted((p["mz"] or -1.0, p["intensity"], p["note"]) for p in got[2]) == [(-1.0, 2.0, "b"), (1.0, 5.0, "a")]
    assert got[3] == [] and got[4] is None


def spectra_of(spark):
    rows = [(k, 100.0 + (k * 7 % 50) / 10, 2 + k % 2) for k in range(400)] + [(400, 101.0, 2), (400, 101.0, 2), (None, 101.0, 2), (401, None, 2)]
    return spark.createDataFrame(rows, "id long, precursor_mz double, precursor_charge int")


def test_masses_stand_for_pairs(spark):
    lib = spectra_of(spark)
    q = lib.where("id % 20 = 0")
    got = {tuple(r[:3]): r["n"] for r in cand.level_pairs(q, lib, 3.0, "Da").collect()}
    mz = lambda df, n: df.select(F.col("id").alias(n), F.col("precursor_mz").alias(f"{n}_mz"))
    pairs = cand.precursor_pairs(q, lib, 3.0, "Da").where("query_id != library_id").distinct()
    plain = q.alias("q").join(lib.alias("l"), F.expr("q.precursor_charge = l.precursor_charge and abs(q.precursor_mz - l.precursor_mz) * q.precursor_charge <= 3.0 and q.id != l.id"))
    want = plain.groupBy("q.precursor_charge", "q.precursor_mz", "l.precursor_mz").count().collect()
    assert got == {tuple(r[:3]): r[3] for r in want} and len(got) < plain.count() / 3 and pairs.count() < plain.count()
    diffs = plain.select(((F.col("q.precursor_mz") - F.col("l.precursor_mz")) * F.col("q.precursor_charge")).alias("mass_diff"), F.lit(1).alias("n"))
    levels = cand.level_pairs(q, lib, 3.0, "Da").withColumn("mass_diff", (F.col("q_mz") - F.col("l_mz")) * F.col("charge"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(fdr.shift_histogram(diffs)) == rows(fdr.shift_histogram(levels, weight="n"))
    one = fdr.shift_groups(diffs, least=40).groupBy("mass_group").count()
    many = fdr.shift_groups(levels, least=40, weight="n").groupBy("mass_group").agg(F.sum("n"))
    assert rows(one) == rows(many) and one.count() > 1


def test_pairs_of_crowded_keys(spark):
    left = spark.createDataFrame([(k, k % 3, "x") for k in range(50)] + [(50, None, "y"), (51, 9, "z")], "id long, k int, note string")
    right = spark.createDataFrame([(k % 3, k) for k in range(2500)] + [(0, None), (0, 0), (None, 7)], "k int, v long")
    out = cand.with_each(left, right, ["k"], "v")
    want = left.join(right, "k")
    rows = lambda df: sorted(map(str, df.select("id", "k", "note", "v").collect()))
    assert rows(out) == rows(want)


def test_pairs_of_crowded_keys_stay_small_in_files(spark, tmp_path):
    """A pair costs a small part of a byte in Parquet: values repeat close by and at whole bytes."""
    left = spark.range(1600).select(F.col("id").alias("a"), F.lit(1).alias("k"), F.lit("name").alias("note"))
    right = spark.range(6001).select(F.lit(1).alias("k"), F.xxhash64("id").alias("v"))
    out = cand.with_each(left, right, ["k"], "v")
    out.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * 1600 * 6001
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["a", "k", "note", "v"] and got.count() == 1600 * 6001
    n = got.groupBy("a").agg(F.countDistinct("v").alias("n"))
    assert [tuple(r) for r in n.select(F.count("*"), F.min("n"), F.max("n")).collect()] == [(1600, 6001, 6001)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_natural_join_is_spread(spark):
    """The customers of one small file are work for all tasks."""
    rows = catalogue.natural_join(spark, SF).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(rows) == 5949 and max(rows) < sum(rows) / 3


def test_files_by_few_rows(spark, tmp_path):
    b = pa.record_batch({"x": list(range(1000))})
    assert [s.num_rows for s in export.by_rows([b], 300)] == [300, 300, 300, 100] and all(s.num_rows <= export.ROWS for s in export.by_rows([b], export.ROWS))
    rows = [(str(k), 100.0 + k, 2, k + 0.5, "PEP", False, [(1.5 + k, 2.0)]) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, precursor_mz double, precursor_charge int, retention_time double, peptide string, is_decoy boolean, peaks array<struct<mz:double,intensity:double>>").coalesce(1)
    for write, name in ((export.write_mzxml, "a.mzXML"), (export.write_mzml, "a.mzML")):
        write(df, str(tmp_path / name))
        got = registry.read_queries(spark, str(tmp_path / name)).select("id", "source_index", "precursor_mz", F.col("peaks")[0]["mz"].alias("mz")).collect()
        assert sorted((int(r["id"]), r["source_index"] - int(r["id"]), r["precursor_mz"], r["mz"]) for r in got) == [(k, got[0]["source_index"] - int(got[0]["id"]), 100.0 + k, 1.5 + k) for k in range(700)]


def test_decoys_by_row(spark):
    """Each row gets one decoy, also of a repeated id, and every other column stays."""
    kind = "id string, precursor_mz double, precursor_charge int, peptide string, is_decoy boolean, peaks array<struct<mz:double,intensity:float,ion_type:string>>, note int"
    rows = [("1", 300.0, 2, "HPYLEDR", False, [(175.119, 2.0, "y"), (500.0, 1.0, None)], 7), ("1", 300.0, None, "HPYLEDR", False, [], 8), ("2", 300.0, 2, None, False, [(5.0, 1.0, None)], 9)]
    df = spark.createDataFrame(rows, kind)
    got = decoy.with_decoys(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    made = sorted(got.where("is_decoy").collect(), key=lambda r: r["note"])
    assert [(r["id"], r["precursor_charge"], r["note"], len(r["peaks"])) for r in made] == [("DECOY_1", 2, 7, 2), ("DECOY_1", None, 8, 0)] and got.count() == 5
    assert made[0]["peptide"] == decoy.shuffle("HPYLEDR")[0] and [p["mz"] for p in made[0]["peaks"]] == [m for m, _ in decoy.reposition("HPYLEDR", 2, [(175.119, 2.0), (500.0, 1.0)], 10.0)[1]]


def test_fragments_at_once():
    masses = [128.05858, 71.03711, 57.02146, 131.04049]
    for charge in (1, 2, 4):
        keys, flat = decoy._layout(4, charge)[0], decoy._masses(masses, charge)
        assert {k: v for k, v in zip(keys, flat.tolist()) if v == v} == decoy.fragments(masses, charge, decoy.LOSSES)
