"""The search: candidates, alignment, best match, scores and false discovery rates, narrow window first and then open."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.functions.similarity import Aligned, cosine, with_features
from ionweave.operators import ann, fdr
from ionweave.operators.block_match import best_in_window
from ionweave.operators.decoy import with_decoys
from ionweave.operators.preprocess import expand_charge, process
from ionweave.operators.rescoring import rescore
from ionweave.operators.vectorize import dense_vectors
from ionweave.sources import versions


@dataclass(frozen=True)
class Prepared:
    """A processed library and, for open approximate searches, the inverted file of its vectors."""

    spectra: DataFrame
    index: ann.Index | None = None


def vectors(spectra: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``(id, charge, vec)`` of processed spectra."""
    return dense_vectors(spectra, cfg.min_mz, cfg.max_mz, cfg.bin_size, cfg.hash_len)


def processed(library: DataFrame, cfg: SearchConfig) -> DataFrame:
    return process(with_decoys(library, seed=cfg.seed) if cfg.add_decoys else library, cfg, is_library=True)


def prepare(library: Callable[[], DataFrame], cfg: SearchConfig, path: str, source: str, spark: SparkSession) -> Prepared:
    """The library of ``source`` as processed under ``cfg``, and its index, from the store at ``path``.

    Whatever the store lacks is built: a changed source or processing setting makes new spectra and a new index, a changed layout a
    new index only. Each is written beside the old version and takes its place at once.
    """
    note = {"source": source, "processing": cfg.processing_hash()}

    def write(at: str) -> None:
        processed(library(), cfg).withColumn("charge", F.col("precursor_charge")).write.partitionBy("charge").parquet(at)

    spectra = spark.read.parquet(versions.build_or_open(spark, f"{path}/spectra", note, write)).drop("charge")
    if not (cfg.has_open_level and cfg.mode == "ann"):
        return Prepared(spectra)
    return Prepared(spectra, ann.build_or_open(vectors(spectra, cfg), f"{path}/index", f"{cfg.layout_hash()}/{cfg.processing_hash()}", source, cfg.num_list, cfg.seed))


def neighbours(queries: DataFrame, index: ann.Index, cfg: SearchConfig) -> DataFrame:
    """``(query_id, charge, near)``: library ids near each query in its charge's index."""
    named = vectors(queries, cfg).withColumn("id", F.concat_ws(":", "charge", F.col("id").cast("string")))
    near = index.search(named, cfg.num_candidates, cfg.num_probe).groupBy("query_id").agg(F.collect_list("library_id").alias("near"))  # ``num_candidates`` at most
    charge = F.substring_index("query_id", ":", 1)
    own = F.expr("substring(query_id, instr(query_id, ':') + 1)").cast(dict(queries.dtypes)["id"])
    return near.select(own.alias("query_id"), charge.cast("int").alias("charge"), "near")


def match_level(queries: DataFrame, library: Prepared, cfg: SearchConfig, level: str) -> DataFrame:
    """The best match of each query within the window of a level."""
    tolerance, mode = (cfg.precursor_tolerance_mass, cfg.precursor_tolerance_mode) if level == "std" else (cfg.precursor_tolerance_mass_open, cfg.precursor_tolerance_mode_open)
    near = neighbours(queries, library.index, cfg) if level == "open" and library.index is not None else None
    best = best_in_window(queries, library.spectra, tolerance, mode, cfg.fragment_mz_tolerance, cfg.allow_peak_shifts, near=near)
    return versions.cut(best.withColumn("level", F.lit(level)))  # a row a query, read for scores, groups and rates


def score(matches: DataFrame, cfg: SearchConfig, grouped: bool) -> DataFrame:
    """Matches with features, ``score``, ``mass_group`` and ``q``; matches without a common peak have neither score nor q."""
    matches = matches.withColumn("ssm_id", F.xxhash64("query_id", "library_id", "charge"))
    difference = (F.col("q_precursor_mz") - F.col("l_precursor_mz")) * F.col("charge")
    some = matches.where(F.size("matches") > 0).withColumn("mass_diff", difference)
    if cfg.model == "none":
        some, pair = Aligned.on(some, "q_peaks", "l_peaks", "matches")
        scored = Aligned.off(some.withColumn("score", cosine(pair)))
    else:
        ppm = (F.col("q_precursor_mz") - F.col("l_precursor_mz")) / F.col("l_precursor_mz") * 1e6
        extra = {"mass_diff_ppm": ppm, "mass_diff_da": difference, "abs_mass_diff_ppm": F.abs(ppm), "abs_mass_diff_da": F.abs(difference), "sequence_len": F.coalesce(F.length("peptide"), F.lit(0)).cast("double")}
        extra |= {f"charge_{n}": c.cast("double") for n, c in charge_flags().items()}
        wide, names = with_features(some, "q_peaks", "l_peaks", "matches", cfg.min_mz, cfg.max_mz, cfg.bin_size)
        scored = rescore(versions.cut(wide.withColumns(extra)), [*names, *extra], cfg.model, cfg.fdr)
    grouped_by = ["mass_group"] if grouped else []
    scored = fdr.shift_groups(scored, least=cfg.fdr_min_group_size) if grouped else scored.withColumn("mass_group", F.lit(None).cast("int"))
    q = fdr.q_values(scored, groups=grouped_by).select("ssm_id", "score", "mass_group", "q")
    return matches.join(q, "ssm_id", "left")


def charge_flags(charge: str = "charge") -> dict:
    c = F.col(charge)
    return {"2": c <= 2, "3": c == 3, "4": c == 4, "5": c >= 5}


def search(queries: DataFrame, library: DataFrame | Prepared, cfg: SearchConfig) -> DataFrame:
    """One row a query: matches accepted in the narrow window, and the open window's matches of all other queries.

    Without an open level every narrow match is kept, whatever its q. A library that isn't prepared is processed, and
    indexed if need be, for this search.
    """
    if isinstance(library, DataFrame):
        raw, name = library, uuid.uuid4().hex
        library = prepare(lambda: raw, cfg, f"{versions.shared_dir(raw.sparkSession)}/search-{name}", name, raw.sparkSession)
    qry = versions.cut(process(expand_charge(queries), cfg, is_library=False))
    narrow = score(match_level(qry, library, cfg, "std"), cfg, grouped=False)
    if not cfg.has_open_level:
        return narrow
    accepted = versions.cut(narrow.where(F.col("q") < cfg.fdr))
    rest = qry.join(accepted.select(F.col("query_id").alias("id")), "id", "left_anti")
    return accepted.unionByName(score(match_level(rest, library, cfg, "open"), cfg, grouped=True))


def count_identified(matches: DataFrame, threshold: float) -> DataFrame:
    return matches.agg(F.count_if(F.col("q") < threshold).alias("n_identified"))
