"""Spectra from text formats (MGF, sptxt), proteins from FASTA, results from mzTab and other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.functions.sequences import fragment_annotation, mgf_to_proforma, sptxt_to_proforma
from ionweave.schema import PEAK
from ionweave.sources.prediction import Predictor, Server, grid, ladder, predict_spectra

NUMBER = r"[0-9.]+(?:[eE][+-]?\d+)?"


def _peaks(pairs: Column, annotation: bool = False) -> Column:
    """Peaks from lines of m/z, intensity and, if any, an annotation."""

    def peak(line: Column) -> Column:
        part = F.split(F.trim(line), r"\s+")
        note = fragment_annotation(F.try_element_at(part, F.lit(3))) if annotation else None
        ion = [note["ion_type"], note["ion_index"], note["charge"]] if annotation else [F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")]
        return F.struct(part[0].cast("double").alias("mz"), part[1].cast("double").alias("intensity"), ion[0].alias("ion_type"), ion[1].alias("ion_index"), ion[2].alias("ion_charge"))

    return F.array_sort(F.transform(pairs, peak)).cast(f"array<{PEAK}>")


def _value(block: Column, key: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?mi)^{key}=(.*)$", 1)), F.lit(""))


def _ordered(spark: SparkSession, path: str, separator: str, starts: str) -> DataFrame:
    """``(block, n)``: the blocks of text files in order, counted from 1 in each file."""
    raw = spark.read.option("lineSep", separator).text(path).select(F.regexp_replace("value", "\r", "").alias("block"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.where(F.col("block").rlike(starts))
    # places in a file come from counts by partition, so no task numbers all blocks
    parts = blocks.withColumn("part", F.shiftright("at", 33)).groupBy("file", "part").agg(F.count("*").alias("rows"))
    before = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("all"))
    from pyspark.sql.window import Window

    local = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    numbered = blocks.withColumn("part", F.shiftright("at", 33)).withColumn("k", local).join(F.broadcast(before), "file")  # a row a byte range of files
    earlier = F.aggregate(F.filter("all", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, p: a + p["rows"])
    return numbered.select("block", (F.col("k") + earlier).cast("int").alias("n"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """BEGIN/END IONS blocks; the id is TITLE, else SCANS or SCAN, else the block's place, which counts from 1."""
    b = F.col("block")
    charge = F.regexp_extract(F.coalesce(_value(b, "CHARGE"), F.lit("")), r"(\d+)", 1)
    return _ordered(spark, path, "END IONS", "BEGIN IONS").select(
        F.coalesce(_value(b, "TITLE"), _value(b, "SCANS?"), F.col("n").cast("string")).alias("id"),
        F.col("n").alias("source_index"),
        F.regexp_extract(_value(b, "PEPMASS"), rf"({NUMBER})", 1).cast("double").alias("precursor_mz"),
        F.nullif(charge, F.lit("")).cast("int").alias("precursor_charge"),
        _value(b, "RTINSECONDS").cast("double").alias("retention_time"),
        mgf_to_proforma(_value(b, "SEQ")).alias("peptide"),
        b.rlike(r"(?mi)^DECOY=").alias("is_decoy"),
        _peaks(F.regexp_extract_all(b, F.lit(rf"(?m)^[ \t]*({NUMBER}[ \t]+{NUMBER})(?:[ \t].*)?$"), 1)).alias("peaks"),
    )


def read_sptxt(spark: SparkSession, path: str) -> DataFrame:
    """Text spectral library: blocks from ``Name:``; ids are their places, from 1."""
    b = F.col("block")
    one = lambda pattern, k=1: F.nullif(F.regexp_extract(b, pattern, k), F.lit(""))
    sequence = one(r"(?m)^[ \t]*(?:Name:[ \t]*)?(?:n\[\d+\])?([A-Za-z\[\]0-9]+)/\d+")
    plain = F.regexp_replace(sequence, r"\[\d+\]", "")
    mz = F.coalesce(one(rf"(?m)^PrecursorMZ:\s*({NUMBER})"), one(rf"Parent=({NUMBER})")).cast("double")
    return _ordered(spark, path, "\nName:", r"(?m)^(?:Name:)?\s*\S+/\d+").select(
        F.col("n").cast("string").alias("id"),
        F.col("n").alias("source_index"),
        mz.alias("precursor_mz"),
        one(r"(?m)^(?:Name:)?\s*\S+/(\d+)").cast("int").alias("precursor_charge"),
        F.lit(None).cast("double").alias("retention_time"),
        sptxt_to_proforma(plain, one(r"Mods=(\S+)")).alias("peptide"),
        F.regexp_replace(b, rf"(?m)^{NUMBER}\t.*$", "").rlike("(?i)decoy").alias("is_decoy"),
        _peaks(F.regexp_extract_all(b, F.lit(rf"(?m)^({NUMBER}\t{NUMBER}(?:\t\S+)?).*$"), 1), annotation=True).alias("peaks"),
    )


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """``(name, sequence)`` of FASTA entries."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''").select(F.regexp_replace("value", "\r", "").alias("v"))
    return raw.select(F.regexp_extract("v", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s|\*", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str, charges: tuple[int, ...] = (2, 3), energies: tuple[int, ...] = (30,), missed: int = 0, predict: Predictor = ladder, batch_size: int = 1000) -> DataFrame:
    """Library spectra of all distinct peptides, charges and collision energies, by a predictor of batches."""
    return predict_spectra(grid(read_proteins(spark, path), charges, energies, missed), predict, batch_size)


def read_fasta_by(spark: SparkSession, path: str, cfg: SearchConfig) -> DataFrame:
    """The same by a search's settings: its charges, energies and missed cleavages, and its prediction server if it names one."""
    charges = tuple(range(cfg.min_precursor_charge, cfg.max_precursor_charge + 1))
    predict = Server(cfg.prediction_server_url, cfg.prediction_model) if cfg.prediction_server_url else ladder
    return read_fasta(spark, path, charges, cfg.collision_energies, cfg.missed_cleavages, predict, cfg.prediction_batch_size)


def read_mztab(spark: SparkSession, path: str) -> DataFrame:
    """The PSM rows of an mzTab file under its own header, decoy flag as boolean."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("PSH\t")).first()[0].split("\t")[1:]
    part = F.split("value", "\t")
    rows = lines.where(F.col("value").startswith("PSM\t")).select(*[F.try_element_at(part, F.lit(k + 2)).alias(n) for k, n in enumerate(head)])
    flags = [n for n in head if n.endswith("decoy_peptide")]
    return rows.withColumns({n: F.col(f"`{n}`").isin("1", "True", "true") for n in flags})


def read_mztab_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The MTD keys and values (some tens of lines)."""
    rows = spark.read.text(path).where(F.col("value").startswith("MTD\t")).select(F.split("value", "\t").alias("p")).collect()
    return {r["p"][1]: r["p"][2] for r in rows if len(r["p"]) > 2}


def settings_of(metadata: dict[str, str]) -> dict[str, str]:
    """Search settings from the metadata's ``key = value`` entries."""
    return dict(v.split(" = ", 1) for k, v in metadata.items() if k.startswith("software[1]-setting") and " = " in v)


def read_pepidx(spark: SparkSession, path: str) -> DataFrame:
    """Peptide index: ``(peptide, modification, ids)``, comments skipped."""
    part = F.split("value", r"\s+", 3)
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(part[0].alias("peptide"), F.try_element_at(part, F.lit(2)).alias("modification"), F.try_element_at(part, F.lit(3)).alias("ids"))


def read_table(spark: SparkSession, path: str, schema: str, footer: str | None = None) -> DataFrame:
    """A tab-separated table with a header, under an explicit schema; rows whose first field matches ``footer`` are dropped."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return df if footer is None else df.where(~F.coalesce(F.col(df.columns[0]).rlike(footer), F.lit(False)))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, seconds)`` of ``real/user/sys XmY.Zs`` lines."""
    return spark.read.text(path).where(F.col("value").rlike(r"^(real|user|sys)\s")).select(F.regexp_extract("value", r"^(\w+)", 1).alias("kind"), seconds(F.col("value")).alias("seconds"))


def seconds(text: Column) -> Column:
    """``XmY.Zs`` in seconds."""
    return F.regexp_extract(text, r"(\d+)m", 1).cast("double") * 60 + F.regexp_extract(text, r"m([\d.]+)s", 1).cast("double")


def read_identified(spark: SparkSession, path: str) -> DataFrame:
    """Sum of all ``N spectra identified`` lines of logs."""
    n = F.regexp_extract("value", r"(\d+)\s+spectra\s+identified", 1)
    return spark.read.text(path).where(n != "").agg(F.sum(n.cast("long")).alias("n_identified"))
