"""Identifications as an mzTab file."""

from __future__ import annotations

import uuid

from pyspark.errors import IllegalArgumentException, UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.functions.sequences import natural_key
from ionweave.schema import MZTAB


def rows(matches: DataFrame, library_uri: str) -> DataFrame:
    """One column a field of the PSM section, nulls as ``null``."""
    null, text = F.lit("null"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    values = {
        "sequence": text("peptide"), "PSM_ID": text("query_id"), "accession": null, "unique": null, "database": F.lit(library_uri), "database_version": null,
        "search_engine": F.lit("[MS, MS:1001456, ionweave,]"), "search_engine_score[1]": text("score"), "search_engine_score[2]": text("q"), "modifications": null,
        "retention_time": text("retention_time"), "charge": text("charge"), "exp_mass_to_charge": text("q_precursor_mz"), "calc_mass_to_charge": text("l_precursor_mz"),
        "spectra_ref": F.concat(F.lit("ms_run[1]:index="), text("source_index")), "pre": null, "post": null, "start": null, "end": null,
        "opt_ms_run[1]_cv_MS:1003062_spectrum_index": text("library_id"), "opt_ms_run[1]_cv_MS:1002217_decoy_peptide": F.col("is_decoy").cast("int").cast("string"), "opt_ms_run[1]_num_candidates": text("num_candidates"),
    }
    return matches.select("query_id", *[values[n].alias(n) for n in MZTAB])


def write(matches: DataFrame, path: str, cfg: SearchConfig, library_uri: str, query_uri: str) -> str:
    """Writes metadata, header and PSM rows in natural order of their ids, as one text file; returns the path with its extension.

    Rows are sorted over all tasks into ordered parts, which the file system joins: by moving blocks where it can, else by one copy
    from stream to stream.
    """
    path = path if path.lower().endswith(".mztab") else path + ".mztab"
    spark = matches.sparkSession
    meta = [("mzTab-version", "1.0.0"), ("mzTab-mode", "Summary"), ("mzTab-type", "Identification"), ("software[1]", "[MS, MS:1001456, ionweave,]"), ("psm_search_engine_score[1]", "[MS, MS:1001143, search engine specific score for PSMs,]"), ("psm_search_engine_score[2]", "[MS, MS:1002354, PSM-level q-value,]"), ("ms_run[1]-location", query_uri), ("false_discovery_rate", f"[MS, MS:1002350, PSM-level global FDR, {cfg.fdr}]")]
    meta += [(f"software[1]-setting[{i}]", f"{k} = {v}") for i, (k, v) in enumerate(cfg.settings().items())]
    head = ["\t".join(("MTD", *m)) for m in meta] + ["\t".join(("PSH", *MZTAB))]
    top = spark.createDataFrame([(0, [f"{i:09d}"], line) for i, line in enumerate(head)], "part int, key array<string>, value string")
    body = rows(matches, library_uri).select(F.lit(1).alias("part"), natural_key(F.col("query_id")).alias("key"), F.concat_ws("\t", F.lit("PSM"), *[F.col(f"`{n}`") for n in MZTAB]).alias("value"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    top.unionByName(body).orderBy("part", "key", "value").select("value").write.text(parts)
    join_parts(spark, parts, path)
    return path


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder``, in order, as the one file ``path``; the folder goes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((str(s.getPath()) for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-") and s.getLen() > 0))
    joined = at(f"{folder}/joined")
    fs.create(joined, True).close()
    try:
        sources = spark.sparkContext._gateway.new_array(at, len(found))
        for k, name in enumerate(found):
            sources[k] = at(name)
        fs.concat(joined, sources)
    except (IllegalArgumentException, UnsupportedOperationException):  # a file system that can't, or not these files
        out = fs.create(joined, True)
        try:
            for name in found:
                part = fs.open(at(name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
        finally:
            out.close()
    fs.delete(at(path), True)
    if not fs.rename(joined, at(path)):
        raise OSError(f"{path} can't be written")
    fs.delete(at(folder), True)
