"""The driver's tables seen as spectra, matches and result sets.

A part is a spectrum: its line items are the peaks (price over 50 is m/z, quantity the intensity), its retail
price the precursor m/z. Searches take every part whose key is divisible by 100 as a query, against
all parts. Events are scored matches, a user is a group and an error a decoy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.operators import matching
from ionweave.operators.block_match import best_in_window
from ionweave.operators.candidates import precursor_pairs
from ionweave.operators.preprocess import by_mz, mz_range, normalise, scale

STD, OPEN, FRAGMENT = 0.95, 20.05, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part, peaks sorted by m/z."""
    peak = F.struct((F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("intensity"))
    peaks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sort_array(F.collect_list(peak)).alias("peaks"))  # a part's items
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("precursor_mz"), (2 + F.col("p_size") % 2).alias("precursor_charge"), F.col("p_name").alias("peptide"), (F.col("p_partkey") % 2 == 1).alias("is_decoy"))
    return part.join(peaks, "id")


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("peaks", mz_range(F.col("peaks"), 11.0, 2010.0))


def queries_of(library: DataFrame) -> DataFrame:
    return library.where(F.col("id") % 100 == 0)


def candidates(spark: SparkSession, sf_dir: str, tolerance: float = STD, mode: str = "Da") -> tuple[DataFrame, DataFrame]:
    """(library, pairs of a query and another spectrum)."""
    library = in_range(spark, sf_dir)
    narrow = library.select("id", "precursor_mz", "precursor_charge")
    return library, precursor_pairs(queries_of(narrow), narrow, tolerance, mode).where("query_id != library_id")


def aligned(spark: SparkSession, sf_dir: str, allow_shift: bool = False, tolerance: float = STD) -> DataFrame:
    library, pairs = candidates(spark, sf_dir, tolerance)
    return matching.align(matching.with_spectra(pairs, queries_of(library), library), FRAGMENT, allow_shift)


def best_with_peaks(spark: SparkSession, sf_dir: str, allow_shift: bool = False, tolerance: float = STD) -> DataFrame:
    """Best matches with both spectra, by blocks."""
    library = in_range(spark, sf_dir)
    return best_in_window(queries_of(library), library, tolerance, "Da", FRAGMENT, allow_shift, exclude_same=True)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matches, with root-scaled and normalised peaks for the similarities."""
    found = best_with_peaks(spark, sf_dir)
    unit = lambda c: normalise(scale(by_mz(F.col(c)), "root", 50))
    return found.where(F.size("matches") > 0).withColumns({"q_peaks": unit("q_peaks"), "l_peaks": unit("l_peaks")})


#: The same in DuckDB SQL, as common table expressions.
SPEC = "spec AS (SELECT p_partkey AS id, p_retailprice AS precursor_mz, 2 + p_size % 2 AS charge, p_name AS peptide, p_partkey % 2 = 1 AS is_decoy FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))"
RAW = "raw AS (SELECT l_partkey AS id, l_extendedprice / 50 AS mz, l_quantity AS intensity FROM lineitem)"
PEAK = RAW + ", peak AS MATERIALIZED (SELECT id, mz, intensity, row_number() OVER (PARTITION BY id ORDER BY mz, intensity) - 1 AS i, sqrt(intensity) / sqrt(sum(intensity) OVER (PARTITION BY id)) AS unit FROM raw WHERE mz BETWEEN 11 AND 2010)"
CAND = f"cand AS MATERIALIZED (SELECT q.id AS query_id, l.id AS library_id, q.charge, q.precursor_mz AS q_mz, l.precursor_mz AS l_mz FROM spec q JOIN spec l ON q.charge = l.charge AND abs(q.precursor_mz - l.precursor_mz) * q.charge <= {STD} WHERE q.id % 100 = 0 AND q.id <> l.id)"
PAIR = f"side_q AS MATERIALIZED (SELECT c.*, q.i AS qi, q.mz, q.intensity FROM cand c JOIN peak q ON q.id = query_id), pp AS (SELECT query_id, library_id, s.charge, qi, l.i AS li, s.intensity * l.intensity AS w FROM side_q s JOIN peak l ON l.id = library_id WHERE abs(s.mz - l.mz) <= {FRAGMENT})"
GREEDY = """greedy AS (SELECT query_id, library_id, charge, list_reduce(list([struct_pack(qi := qi, li := li, w := w)] ORDER BY w DESC, qi, li), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.qi = x[1].qi OR y.li = x[1].li)) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM pp GROUP BY ALL)"""
SCORED = "scored AS (SELECT c.query_id, c.library_id, c.charge, coalesce(len(m), 0) AS n, coalesce(list_sum(list_transform(m, lambda x: x.w)), 0) AS dot, m FROM cand c LEFT JOIN greedy g ON c.query_id = g.query_id AND c.library_id = g.library_id)"
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, library_id) AS k FROM scored) WHERE k = 1 AND n > 0)"
ALIGNED = ", ".join((SPEC, PEAK, CAND, PAIR, GREEDY, SCORED, BEST))
#: Matched and unmatched peaks of the best matches, a row each.
SIDES = (
    "mt AS (SELECT query_id, library_id, u.qi AS qi, u.li AS li FROM (SELECT query_id, library_id, unnest(m) AS u FROM best)), "
    "hit AS (SELECT query_id, q.unit AS q, l.unit AS l, q.mz AS mq, l.mz AS ml FROM mt JOIN peak q ON q.id = query_id AND q.i = qi JOIN peak l ON l.id = library_id AND l.i = li), "
    "qonly AS (SELECT b.query_id, p.unit AS v FROM best b JOIN peak p ON p.id = b.query_id WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.query_id = b.query_id AND mt.qi = p.i)), "
    "lonly AS (SELECT b.query_id, p.unit AS v FROM best b JOIN peak p ON p.id = b.library_id WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.query_id = b.query_id AND mt.li = p.i)), "
    "h AS (SELECT query_id, count(*) AS n, sum(q * l) AS ql, sum(q) AS sq, sum(l) AS sl, sum(abs(q - l)) AS gap, sum((q - l) ** 2) AS gap2, max(abs(q - l)) AS top, sum(abs(q + l)) AS qpl, sum(least(q, l)) AS lo, sum(greatest(q, l)) AS hi, sum(abs(mq - ml)) AS mgap, sum((mq - ml) ** 2) AS mgap2, sum(CASE WHEN q + l = 0 THEN 0 ELSE abs(q - l) / (q + l) END) AS canb FROM hit GROUP BY 1), "
    "uq AS (SELECT query_id, count(*) AS n, sum(v) AS s, sum(v * v) AS s2, max(v) AS top, count_if(v <> 0) AS some FROM qonly GROUP BY 1), "
    "ul AS (SELECT query_id, count(*) AS n, sum(v) AS s, sum(v * v) AS s2, max(v) AS top, count_if(v <> 0) AS some FROM lonly GROUP BY 1), "
    "a AS (SELECT h.*, coalesce(uq.n, 0) AS nuq, coalesce(ul.n, 0) AS nul, coalesce(uq.s, 0) AS suq, coalesce(ul.s, 0) AS sul, coalesce(uq.s2, 0) AS suq2, coalesce(ul.s2, 0) AS sul2, coalesce(uq.top, 0) AS tuq, coalesce(ul.top, 0) AS tul, coalesce(uq.some, 0) AS cuq, coalesce(ul.some, 0) AS cul FROM h LEFT JOIN uq USING (query_id) LEFT JOIN ul USING (query_id))"
)
