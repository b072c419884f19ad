"""Readers by file extension, and the library store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.sources.binary import read_mzml, read_mzxml, read_splib
from ionweave.sources.text import read_fasta, read_fasta_by, read_mgf, read_sptxt

QUERY_READERS = {".mgf": read_mgf, ".mzml": read_mzml, ".mzxml": read_mzxml}
LIBRARY_READERS = {".splib": read_splib, ".sptxt": read_sptxt, ".mgf": read_mgf, ".fasta": read_fasta}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def verify(spark: SparkSession, path: str, supported: dict) -> str:
    """The lower-case extension; ``FileNotFoundError`` if it isn't supported or nothing is there."""
    kind = extension(path)
    if kind not in supported:
        raise FileNotFoundError(f"{path}: {kind or 'no extension'} is none of {', '.join(supported)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        raise FileNotFoundError(path)
    return kind


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return QUERY_READERS[verify(spark, path, QUERY_READERS)](spark, path)


def read_library(spark: SparkSession, path: str, cfg: SearchConfig | None = None) -> DataFrame:
    """A library file; with settings, sequences are digested and predicted by them."""
    kind = verify(spark, path, LIBRARY_READERS)
    return read_fasta_by(spark, path, cfg) if kind == ".fasta" and cfg is not None else LIBRARY_READERS[kind](spark, path)


def write_store(library: DataFrame, path: str, cfg: SearchConfig, source: str = "") -> None:
    """The library as Parquet by charge, with its source and layout hash beside it."""
    library.withColumn("charge", F.col("precursor_charge")).write.mode("overwrite").partitionBy("charge").parquet(f"{path}/spectra")
    note = json.dumps({"source": source, "layout": cfg.layout_hash()})
    library.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def is_current(spark: SparkSession, path: str, cfg: SearchConfig, source: str = "") -> bool:
    """Whether a store exists that has this source and layout."""
    try:
        note = json.loads(spark.read.text(f"{path}/layout").first()[0])
        spark.read.parquet(f"{path}/spectra")
    except Exception as e:  # a missing or broken store is built anew
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return note == {"source": source, "layout": cfg.layout_hash()}


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All spectra of a store; a filter on ``charge`` prunes files, one on ``id`` is pushed into them."""
    return spark.read.parquet(f"{path}/spectra")


def build_or_open(spark: SparkSession, source: str, path: str, cfg: SearchConfig) -> DataFrame:
    name = source.rsplit("/", 1)[-1]
    if not is_current(spark, path, cfg, name):
        write_store(read_library(spark, source), path, cfg, name)
    return open_store(spark, path)
