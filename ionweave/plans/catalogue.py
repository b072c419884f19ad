"""Registered queries of the engine over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import sequences as seq
from ionweave.functions import similarity as sim
from ionweave.operators import analysis, ann, fdr, forest, matching, vectorize
from ionweave.operators import candidates as cand
from ionweave.operators import preprocess as pre
from ionweave.operators.block_match import all_in_window, best_in_window
from ionweave.plans import fixtures as fx
from ionweave.plans.fixtures import ALIGNED, CAND, GREEDY, PAIR, PEAK, RAW, SCORED, SIDES, SPEC, table
from ionweave.sources import binary, export, registry, text, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def peaks_summary(df: DataFrame) -> DataFrame:
    """Peaks of each spectrum as a count and rounded sums."""
    return df.select("id", F.size(F.col("peaks")).alias("n"), r6(pre.total(pre.field(F.col("peaks"), "mz")), "sum_mz"), r6(pre.total(pre.field(F.col("peaks"), "intensity")), "sum_intensity"))


SUMMARY = "count(*) AS n, round(sum(mz), 6) AS sum_mz, round(sum(intensity), 6) AS sum_intensity"


# --- peak lists ---------------------------------------------------------------------------------
@query(f"WITH {SPEC}, {PEAK} SELECT id, {SUMMARY} FROM peak JOIN spec USING (id) GROUP BY id")
def preprocess_mz_range(spark, d):
    return peaks_summary(fx.in_range(spark, d)).where("n > 0")


@query(f"WITH {SPEC}, {PEAK} SELECT id, coalesce(count(mz) >= 25 AND max(mz) - min(mz) >= 1500, false) AS is_valid FROM spec LEFT JOIN peak USING (id) GROUP BY id")
def spectrum_validity(spark, d):
    return fx.in_range(spark, d).select("id", pre.is_valid(F.col("peaks"), 25, 1500.0).alias("is_valid"))


@query(f"WITH {SPEC}, {RAW} SELECT id, mz, sum(intensity) AS intensity FROM (SELECT id, round(mz, -1) AS mz, intensity FROM raw JOIN spec USING (id)) GROUP BY ALL")
def round_merge_peaks(spark, d):
    merged = fx.spectra(spark, d).select("id", F.explode(pre.round_and_merge(F.col("peaks"), -1)).alias("p"))
    return merged.select("id", "p.mz", "p.intensity")


@query(
    f"WITH {SPEC}, {PEAK}, spot AS (SELECT id, ((precursor_mz - 1.00727646687) * charge + k * 1.00335483507) / z + 1.00727646687 AS m FROM spec, (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([1, 2, 3]) AS z) WHERE z <= charge) "
    f"SELECT id, {SUMMARY} FROM peak JOIN spec USING (id) WHERE NOT EXISTS (SELECT 1 FROM spot WHERE spot.id = peak.id AND abs(peak.mz - spot.m) <= 5.03) GROUP BY id"
)
def remove_precursor_peak(spark, d):
    kept = pre.without_precursor(F.col("peaks"), F.col("precursor_mz"), F.col("precursor_charge"), 5.03)
    return peaks_summary(fx.in_range(spark, d).withColumn("peaks", kept)).where("n > 0")


@query(f"WITH {SPEC}, {PEAK}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS place FROM (SELECT *, max(intensity) OVER (PARTITION BY id) AS m FROM peak JOIN spec USING (id)) WHERE intensity > m * 0.1) SELECT id, {SUMMARY} FROM k WHERE place <= 20 GROUP BY id")
def topk_peaks(spark, d):
    return peaks_summary(fx.in_range(spark, d).withColumn("peaks", pre.filter_intensity(F.col("peaks"), 0.1, 20))).where("n > 0")


@query(f"WITH {SPEC}, {PEAK} SELECT id, round(mz, 6) AS mz, CAST(51 - row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS DOUBLE) AS rank_intensity FROM peak JOIN spec USING (id)")
def rank_scale(spark, d):
    return fx.in_range(spark, d).select("id", F.explode(pre.scale(F.col("peaks"), "rank", 50)).alias("p")).select("id", r6(F.col("p.mz"), "mz"), F.col("p.intensity").alias("rank_intensity"))


@query(f"WITH {SPEC}, {PEAK} SELECT id, round(mz, 6) AS mz, round(unit, 6) AS unit FROM peak JOIN spec USING (id)")
def l2_normalise(spark, d):
    return fx.in_range(spark, d).select("id", F.explode(pre.normalise(pre.scale(F.col("peaks"), "root", 50))).alias("p")).select("id", r6(F.col("p.mz"), "mz"), r6(F.col("p.intensity"), "unit"))


@query("SELECT p_partkey AS id, unnest(CASE WHEN p_size > 25 THEN [2, 3] ELSE [2 + p_size % 2] END) AS precursor_charge FROM part")
def charge_expand(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, 2 + F.col("p_size") % 2).alias("precursor_charge"))
    return pre.expand_charge(part)


@query(f"WITH {SPEC}, {PEAK}, b AS (SELECT id, CAST(floor((mz - 10.0) / 10.0) AS INT) AS slot, sum(intensity) AS w FROM peak JOIN spec USING (id) GROUP BY ALL) SELECT id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM b")
def bin_vectorise(spark, d):
    v = vectorize.vectorise(fx.in_range(spark, d), 11.0, 2010.0, 10.0, None)
    return v.select("id", F.explode("entries").alias("e")).select("id", F.col("e.slot").alias("slot"), r6(F.col("e.w"), "w"))


def murmur_sql(bins: str) -> str:
    """The 32-bit hash of bin numbers' decimal text (one to five digits), modulo 800, as common table expressions over ``bins(bin)``."""
    m, turn = 4294967296, lambda x, k: f"({x} * {1 << k} % 4294967296 + ({x} // {1 << 32 - k}))"
    byte = lambda k: f"CASE WHEN length(t) >= {k} THEN ascii(substr(t, {k}, 1)) ELSE 0 END"
    mixed = lambda x: f"({turn(f'({x} * 3432918353 % {m})', 15)} * 461845907 % {m})"
    fmix = lambda x, k, f: f"(xor({x}, {x} // {1 << k}) * {f} % {m})"
    head = f"CAST(CASE WHEN length(t) >= 4 THEN {byte(1)} + {byte(2)} * 256 + {byte(3)} * 65536 + {byte(4)} * 16777216 ELSE 0 END AS UBIGINT) AS k1"
    tail = f"CAST(CASE WHEN length(t) >= 4 THEN {byte(5)} ELSE {byte(1)} + {byte(2)} * 256 + {byte(3)} * 65536 END AS UBIGINT) AS k2"
    return (
        f"h0 AS (SELECT bin, t, {head}, {tail} FROM (SELECT bin, CAST(bin AS VARCHAR) AS t FROM {bins})), "
        f"h1 AS (SELECT bin, t, k2, CASE WHEN length(t) >= 4 THEN xor(CAST(42 AS UBIGINT), {mixed('k1')}) ELSE CAST(42 AS UBIGINT) END AS h FROM h0), "
        f"h2 AS (SELECT bin, t, k2, CASE WHEN length(t) >= 4 THEN ({turn('h', 13)} * 5 + 3864292196) % {m} ELSE h END AS h FROM h1), "
        f"h3 AS (SELECT bin, xor(xor(h, {mixed('k2')}), CAST(length(t) AS UBIGINT)) AS h FROM h2), h4 AS (SELECT bin, {fmix('h', 16, 2246822507)} AS h FROM h3), "
        f"h5 AS (SELECT bin, {fmix('h', 13, 3266489909)} AS h FROM h4), slots AS (SELECT bin, CAST(xor(h, h // 65536) % 800 AS INT) AS slot FROM h5)"
    )


@query(
    f"WITH {SPEC}, {PEAK}, fine AS MATERIALIZED (SELECT id, intensity, CAST(round(((mz - {vectorize.dimensions(11.0, 2010.0, 0.04)[1]!r}) - (mz - {vectorize.dimensions(11.0, 2010.0, 0.04)[1]!r}) % CAST(0.04 AS DOUBLE)) / CAST(0.04 AS DOUBLE)) AS INT) AS bin FROM peak JOIN spec USING (id)), seen AS (SELECT DISTINCT bin FROM fine), {murmur_sql('seen')}, "
    "b AS (SELECT id, slot, sum(intensity) AS w FROM fine JOIN slots USING (bin) GROUP BY ALL) SELECT id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM b"
)
def hash_vectorise(spark, d):
    v = vectorize.vectorise(fx.in_range(spark, d), 11.0, 2010.0, 0.04, 800)
    return v.select("id", F.explode("entries").alias("e")).select("id", F.col("e.slot").alias("slot"), r6(F.col("e.w"), "w"))


# --- candidates and neighbours ----------------------------------------------------------------
@query(f"WITH {SPEC}, {CAND} SELECT query_id, library_id, charge FROM cand")
def band_join_da(spark, d):
    return fx.candidates(spark, d)[1]


@query(f"WITH {SPEC} SELECT q.id AS query_id, l.id AS library_id, q.charge FROM spec q JOIN spec l ON q.charge = l.charge AND abs(q.precursor_mz - l.precursor_mz) / l.precursor_mz * 1e6 <= 333.3 WHERE q.id % 100 = 0 AND q.id <> l.id")
def band_join_ppm(spark, d):
    return fx.candidates(spark, d, 333.3, "ppm")[1]


@query("SELECT 2 + p_size % 2 AS charge, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 50")
def library_count_by_charge(spark, d):
    part = table(spark, d, "part").select((2 + F.col("p_size") % 2).alias("precursor_charge"))
    return cand.library_counts(part, 50)


def embedded(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


KNN = "knn AS (SELECT query_id, library_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, library_id) AS rank FROM (SELECT q.vec_id AS query_id, l.vec_id AS library_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings l WHERE q.vec_id % 100 = 0))"


@query(f"WITH {KNN} SELECT query_id, library_id, round(s, 6) AS score, rank FROM knn WHERE rank <= 10")
def exact_knn_topk(spark, d):
    v = embedded(spark, d)
    return ann.exact_neighbours(v.where(F.col("id") % 100 == 0), v, 10).select("query_id", "library_id", r6(F.col("score"), "score"), "rank")


@query(f"WITH {KNN}, {SPEC}, {CAND} SELECT c.query_id, c.library_id, c.charge FROM cand c WHERE charge = 2 OR EXISTS (SELECT 1 FROM knn k WHERE k.query_id = c.query_id AND k.library_id = c.library_id AND rank <= 50)")
def candidate_semi_join(spark, d):
    v = embedded(spark, d)
    near = ann.exact_neighbours(v.where(F.col("id") % 100 == 0), v, 50).select("query_id", "library_id")
    return cand.restrict(fx.candidates(spark, d)[1], near, spark.createDataFrame([(3,)], "charge int")).select("query_id", "library_id", "charge")


def stored_index(spark, d) -> ann.Index:
    """The inverted file of the embeddings, built at the first call for a table and opened after that."""
    source = versions.source_mark(spark, f"{d}/embeddings.parquet")
    path = f"{versions.shared_dir(spark)}/ivf-{hashlib.sha1(d.encode()).hexdigest()[:12]}"
    return ann.build_or_open(embedded(spark, d).withColumn("charge", F.lit(0)), path, "embeddings", source, 16)


def asked_of(spark, d) -> DataFrame:
    return embedded(spark, d).where(F.col("id") % 100 == 0).withColumn("charge", F.lit(0))


@query()
def ivf_knn(spark, d):
    near = stored_index(spark, d).search(asked_of(spark, d), 10, 12)
    return near.select("query_id", "library_id", r6(F.col("score"), "score"), "rank")


@query(f"WITH {KNN} SELECT query_id, library_id, round(s, 6) AS score, rank FROM knn WHERE rank <= 10")
def ivf_all_cells(spark, d):
    """The stored inverted file with every cell probed: the exact neighbours."""
    near = stored_index(spark, d).search(asked_of(spark, d), 10, 16)
    return near.select("query_id", "library_id", r6(F.col("score"), "score"), "rank")


@query("SELECT label AS charge, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 8")
def ivf_sizes(spark, d):
    """Vectors filed in an inverted file by charge (the label here), none for charges with fewer vectors than cells."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("charge"))
    path = f"{versions.shared_dir(spark)}/ivf-label-{hashlib.sha1(d.encode()).hexdigest()[:12]}"
    index = ann.build_or_open(v, path, "embeddings by label", versions.source_mark(spark, f"{d}/embeddings.parquet"), 8)
    return index.vectors().groupBy("charge").agg(F.count("*").alias("n"))


def stored_forest(spark, d) -> forest.Forest:
    path = f"{versions.shared_dir(spark)}/forest-{hashlib.sha1(d.encode()).hexdigest()[:12]}"
    return forest.build_or_open(embedded(spark, d), path, versions.source_mark(spark, f"{d}/embeddings.parquet"))


@query()
def forest_knn(spark, d):
    near = stored_forest(spark, d).search(asked_of(spark, d), 10)
    return near.select("query_id", "library_id", r6(F.col("score"), "score"), "rank")


@query("SELECT CAST(tree AS INT) AS tree, vec_id AS id FROM embeddings, (SELECT unnest(range(10)) AS tree)")
def forest_members(spark, d):
    """Every vector lies in one leaf of each tree."""
    return stored_forest(spark, d).part("leaves").select("tree", "id")


@query(f"WITH {KNN} SELECT q.vec_id AS query_id, min(rank) AS rank FROM embeddings q JOIN knn k ON k.query_id = q.vec_id JOIN embeddings l ON l.vec_id = k.library_id AND l.label <> q.label GROUP BY 1")
def correct_neighbour_rank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return ann.rank_of_other(v.where(F.col("id") % 100 == 0), v)


# --- alignment ---------------------------------------------------------------------------------
def pairs_of(spark, d, shifted: bool) -> DataFrame:
    """All matching peak pairs of each pair of spectra, as counts and sums."""
    library = fx.in_range(spark, d)
    p = all_in_window(fx.queries_of(library), library, fx.STD, "Da", fx.FRAGMENT, shifted, exclude_same=True, least_shift=0.55)
    return p.select("query_id", "library_id", "n", "places", r6(F.col("w"), "w"))


@query(f"WITH {SPEC}, {PEAK}, {CAND}, {PAIR} SELECT query_id, library_id, count(*) AS n, CAST(sum(qi * 1000 + li) AS BIGINT) AS places, round(sum(w), 6) AS w FROM pp GROUP BY 1, 2")
def peak_pairs(spark, d):
    return pairs_of(spark, d, False)


@query(
    f"WITH {SPEC}, {PEAK}, {CAND}, mv AS (SELECT *, unnest(CASE WHEN abs((q_mz - l_mz) * charge) >= 0.55 THEN range(0, charge + 1) ELSE [0] END) AS k FROM cand), sh AS MATERIALIZED (SELECT mv.*, CASE WHEN k = 0 THEN 0.0 ELSE (q_mz - l_mz) * charge / k END AS s, q.i AS qi, q.mz, q.intensity FROM mv JOIN peak q ON q.id = query_id) "
    f"SELECT query_id, library_id, count(*) AS n, CAST(sum(qi * 1000 + l.i) AS BIGINT) AS places, round(sum(sh.intensity * l.intensity * CASE WHEN s = 0 THEN 1 ELSE 2.0 / 3.0 END), 6) AS w FROM sh JOIN peak l ON l.id = library_id WHERE abs(sh.mz - (l.mz + s)) <= {fx.FRAGMENT} GROUP BY 1, 2"
)
def peak_pairs_shifted(spark, d):
    return pairs_of(spark, d, True)


@query(f"WITH {ALIGNED}, u AS (SELECT query_id, library_id, unnest(m) AS x FROM greedy) SELECT query_id, library_id, x.qi AS qi, x.li AS li, x.w AS w FROM u")
def greedy_match(spark, d):
    library = fx.in_range(spark, d)
    m = all_in_window(fx.queries_of(library), library, fx.STD, "Da", fx.FRAGMENT, False, exclude_same=True, matches=True)
    return m.select("query_id", "library_id", F.col("q").alias("qi"), F.col("l").alias("li"), "w")


@query(f"WITH {ALIGNED} SELECT query_id, library_id, charge, n AS n_matches, round(dot, 6) AS dot FROM best")
def best_match(spark, d):
    b = fx.best_with_peaks(spark, d).where(F.size("matches") > 0)
    return b.select("query_id", "library_id", "charge", F.size("matches").alias("n_matches"), r6(F.col("dot"), "dot"))


@query(
    f"WITH {SPEC}, {PEAK}, {CAND.replace(str(fx.STD), str(fx.OPEN))}, mv AS (SELECT *, unnest(CASE WHEN abs((q_mz - l_mz) * charge) >= {fx.FRAGMENT} THEN range(0, charge + 1) ELSE [0] END) AS k FROM cand), sh AS MATERIALIZED (SELECT mv.*, CASE WHEN k = 0 THEN 0.0 ELSE (q_mz - l_mz) * charge / k END AS s, q.i AS qi, q.mz, q.intensity FROM mv JOIN peak q ON q.id = query_id), "
    f"pp AS (SELECT query_id, library_id, sh.charge, qi, l.i AS li, sh.intensity * l.intensity * CASE WHEN s = 0 THEN 1 ELSE 2.0 / 3.0 END AS w FROM sh JOIN peak l ON l.id = library_id WHERE abs(sh.mz - (l.mz + s)) <= {fx.FRAGMENT}), {GREEDY}, {SCORED}, "
    "n AS (SELECT query_id, count(*) AS num_candidates FROM cand GROUP BY 1) SELECT query_id, library_id, charge, n AS n_matches, round(dot, 6) AS dot, num_candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, library_id) AS k FROM scored) JOIN n USING (query_id) WHERE k = 1"
)
def best_match_shifted(spark, d):
    """The search's own kernel over the open window."""
    b = fx.best_with_peaks(spark, d, True, fx.OPEN)
    return b.select("query_id", "library_id", "charge", F.size("matches").alias("n_matches"), r6(F.col("dot"), "dot"), "num_candidates")


@query(
    f"WITH {SPEC}, {PEAK}, {CAND}, {PAIR}, {GREEDY}, {SCORED}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, library_id) AS k FROM scored) WHERE k = 1), mt AS (SELECT query_id, u.qi AS qi, u.li AS li FROM (SELECT query_id, unnest(m) AS u FROM b)) "
    "SELECT b.query_id, library_id, 'q' AS side, p.i, round(mz, 6) AS mz, li AS partner, 'b' || li AS ion FROM b JOIN peak p ON p.id = b.query_id LEFT JOIN mt ON mt.query_id = b.query_id AND mt.qi = p.i "
    "UNION ALL SELECT b.query_id, library_id, 'l', p.i, round(mz, 6), qi, CASE WHEN qi IS NOT NULL THEN 'b' || p.i END FROM b JOIN peak p ON p.id = b.library_id LEFT JOIN mt ON mt.query_id = b.query_id AND mt.li = p.i"
)
def annotated_match(spark, d):
    kind = "array<struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>>"
    full = lambda c: F.transform(c, lambda p, i: F.struct(p["mz"], p["intensity"], F.lit("b"), i, F.lit(1))).cast(kind)
    b = fx.best_with_peaks(spark, d).withColumn("l_peaks", full("l_peaks"))
    return matching.annotated_pairs(b).select("query_id", "library_id", "side", "i", r6(F.col("mz"), "mz"), "partner", "ion")


@query(
    f"WITH {SPEC}, {PEAK}, {CAND.replace(str(fx.STD), str(fx.OPEN))}, mv AS (SELECT *, unnest(CASE WHEN abs((q_mz - l_mz) * charge) >= {fx.FRAGMENT} THEN range(0, charge + 1) ELSE [0] END) AS k FROM cand), sh AS MATERIALIZED (SELECT mv.*, CASE WHEN k = 0 THEN 0.0 ELSE (q_mz - l_mz) * charge / k END AS s, q.i AS qi, q.mz, q.intensity FROM mv JOIN peak q ON q.id = query_id), "
    f"pp AS (SELECT query_id, library_id, sh.charge, qi, l.i AS li, sh.intensity * l.intensity * CASE WHEN s = 0 OR l.i % 3 = k THEN 1 ELSE 2.0 / 3.0 END AS w FROM sh JOIN peak l ON l.id = library_id WHERE abs(sh.mz - (l.mz + s)) <= {fx.FRAGMENT} AND (s = 0 OR l.i % 3 = k OR l.i % 3 = 0)), {GREEDY}, {SCORED} "
    "SELECT query_id, library_id, charge, n AS n_matches, round(dot, 6) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, library_id) AS k FROM scored) WHERE k = 1"
)
def best_match_annotated(spark, d):
    """Shifted peaks count in full at their annotated charge, by two thirds without one, and not at another."""
    kind = "array<struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>>"
    noted = F.transform("peaks", lambda p, i: F.struct(p["mz"], p["intensity"], F.lit("b"), i, F.when(i % 3 > 0, i % 3))).cast(kind)
    library = fx.in_range(spark, d).withColumn("peaks", noted)
    b = best_in_window(fx.queries_of(library), library, fx.OPEN, "Da", fx.FRAGMENT, True, annotated=True, exclude_same=True)
    return b.select("query_id", "library_id", "charge", F.size("matches").alias("n_matches"), r6(F.col("dot"), "dot"))


# --- similarities ------------------------------------------------------------------------------
def similarity(spark, d, **columns) -> DataFrame:
    s, a = sim.Aligned.on(fx.best(spark, d), "q_peaks", "l_peaks", "matches")
    return s.select("query_id", *[r6(f(a), n) for n, f in columns.items()])


def similar_sql(**columns: str) -> str:
    return f"WITH {ALIGNED}, {SIDES} SELECT query_id, " + ", ".join(f"round({v}, 6) AS {n}" for n, v in columns.items()) + " FROM a"


@query(similar_sql(cosine="ql", contrast="1 - 2 * acos(least(greatest(ql, 0), 1)) / pi()", scribe="ln(1 / (gap2 + sul2))"))
def sim_angles(spark, d):
    return similarity(spark, d, cosine=sim.cosine, contrast=sim.spectral_contrast_angle, scribe=sim.scribe_fragment_acc)


@query(similar_sql(n_matched="CAST(n AS DOUBLE)", frac_n_query="n / (n + nuq)", frac_n_library="n / (n + nul)", frac_i_query="sq / (sq + suq)", frac_i_library="sl / (sl + sul)"))
def sim_fractions(spark, d):
    return similarity(spark, d, n_matched=sim.n_matched_peaks, frac_n_query=sim.frac_n_peaks_query, frac_n_library=sim.frac_n_peaks_library, frac_i_query=sim.frac_intensity_query, frac_i_library=sim.frac_intensity_library)


@query(similar_sql(mse_mz="mgap2 / n", mse_intensity="gap2 / n", manhattan="gap + suq + sul", euclidean="sqrt(gap2 + suq2 + sul2)", chebyshev="greatest(top, tuq, tul)", braycurtis="(gap + suq + sul) / (qpl + suq + sul)", canberra="canb + cuq + cul", ruzicka="lo / (hi + suq + sul)"))
def sim_distances(spark, d):
    return similarity(spark, d, mse_mz=lambda a: sim.mean_squared_error(a, "mz"), mse_intensity=lambda a: sim.mean_squared_error(a, "intensity"), manhattan=sim.manhattan, euclidean=sim.euclidean, chebyshev=sim.chebyshev, braycurtis=sim.braycurtis, canberra=sim.canberra, ruzicka=sim.ruzicka)


@query(similar_sql(v1="least(n ** 4 / ((n + nuq) * (n + nul) * greatest(gap, 2.220446049250313e-16) ** 0.25), 1000)", v2="n ** 4 * (sq + suq + 2 * (sl + sul)) ** 1.25 / ((n + nuq + 2 * (n + nul)) ** 2 + gap + mgap)"))
def sim_ms_for_id(spark, d):
    return similarity(spark, d, v1=sim.ms_for_id_v1, v2=sim.ms_for_id_v2)


@query(
    f"WITH {ALIGNED}, {SIDES}, xy AS (SELECT query_id, q AS x, l AS y FROM hit UNION ALL SELECT l.query_id, 0, v FROM lonly l JOIN h USING (query_id)), rk AS (SELECT query_id, x, y, rank() OVER (PARTITION BY query_id ORDER BY x) + (count(*) OVER (PARTITION BY query_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY query_id ORDER BY y) + (count(*) OVER (PARTITION BY query_id, y) - 1) / 2 AS ry FROM xy), "
    "ok AS (SELECT query_id, count(*) AS n, max(x) > min(x) AND max(y) > min(y) AS varies FROM rk GROUP BY 1) SELECT query_id, round(CASE WHEN any_value(varies) THEN corr(x, y) ELSE 0 END, 6) AS pearson, round(CASE WHEN any_value(varies) THEN corr(rx, ry) ELSE 0 END, 6) AS spearman FROM rk JOIN ok USING (query_id) GROUP BY query_id"
)
def sim_correlations(spark, d):
    return similarity(spark, d, pearson=sim.pearsonr, spearman=sim.spearmanr)


_H = "(SELECT query_id, CASE WHEN count(*) = 0 THEN 0 ELSE -sum(CASE WHEN v > 0 THEN v / t * ln(v / t) ELSE 0 END) END AS h FROM (SELECT query_id, v, sum(v) OVER (PARTITION BY query_id) AS t FROM {0}) GROUP BY 1)"


@query(
    f"WITH {ALIGNED}, {SIDES}, fq AS (SELECT b.query_id, unit AS v FROM best b JOIN peak p ON p.id = b.query_id), fl AS (SELECT b.query_id, unit AS v FROM best b JOIN peak p ON p.id = b.library_id), mg AS (SELECT query_id, (q + l) / 2 AS v FROM hit UNION ALL SELECT query_id, v / 2 FROM qonly UNION ALL SELECT query_id, v / 2 FROM lonly), "
    f"wq AS (SELECT query_id, v ** CASE WHEN h > 3 THEN 1 ELSE 0.25 + 0.25 * h END AS v FROM fq JOIN {_H.format('fq')} USING (query_id)), wl AS (SELECT query_id, v ** CASE WHEN h > 3 THEN 1 ELSE 0.25 + 0.25 * h END AS v FROM fl JOIN {_H.format('fl')} USING (query_id)), wm AS (SELECT query_id, v ** CASE WHEN h > 3 THEN 1 ELSE 0.25 + 0.25 * h END AS v FROM mg JOIN {_H.format('mg')} USING (query_id)) "
    f"SELECT m.query_id, round(1 - (2 * m.h - q.h - l.h) / ln(4), 6) AS unweighted, round(1 - (2 * xm.h - xq.h - xl.h) / ln(4), 6) AS weighted FROM {_H.format('mg')} m JOIN {_H.format('fq')} q USING (query_id) JOIN {_H.format('fl')} l USING (query_id) JOIN {_H.format('wm')} xm USING (query_id) JOIN {_H.format('wq')} xq USING (query_id) JOIN {_H.format('wl')} xl USING (query_id)"
)
def sim_entropy(spark, d):
    return similarity(spark, d, unweighted=sim.entropy, weighted=lambda a: sim.entropy(a, weighted=True))


_TOP = (
    "tp AS (SELECT id, i FROM (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS k FROM peak) WHERE k <= 5), "
    "ht AS (SELECT mt.query_id, q.unit AS q, l.unit AS l, q.mz AS mq, l.mz AS ml FROM mt JOIN peak q ON q.id = query_id AND q.i = qi JOIN peak l ON l.id = library_id AND l.i = li JOIN tp ON tp.id = library_id AND tp.i = li), "
    "lt AS (SELECT b.query_id, p.unit AS v FROM best b JOIN peak p ON p.id = b.library_id JOIN tp ON tp.id = p.id AND tp.i = p.i WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.query_id = b.query_id AND mt.li = p.i)), "
    "th AS (SELECT query_id, count(*) AS n, sum(q * l) / sqrt(sum(q * q) * sum(l * l)) AS cs, sum(l) AS sl, sum(abs(q - l)) AS gap, sum((q - l) ** 2) AS gap2, sum((mq - ml) ** 2) AS mgap2 FROM ht GROUP BY 1), tu AS (SELECT query_id, count(*) AS nul, sum(v) AS sul, sum(v * v) AS sul2 FROM lt GROUP BY 1), "
    "ta AS (SELECT th.*, coalesce(nul, 0) AS nul, coalesce(sul, 0) AS sul, coalesce(sul2, 0) AS sul2 FROM th LEFT JOIN tu USING (query_id)), "
    "txy AS (SELECT query_id, q AS x, l AS y FROM ht UNION ALL SELECT l.query_id, 0, v FROM lt l JOIN th USING (query_id)), trk AS (SELECT query_id, x, y, rank() OVER (PARTITION BY query_id ORDER BY x) + (count(*) OVER (PARTITION BY query_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY query_id ORDER BY y) + (count(*) OVER (PARTITION BY query_id, y) - 1) / 2 AS ry FROM txy), "
    "tc AS (SELECT query_id, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) ELSE 0 END AS pearson, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(rx, ry) ELSE 0 END AS spearman FROM trk GROUP BY 1)"
)


@query(
    f"WITH {ALIGNED}, {SIDES}, {_TOP} SELECT query_id, round(cs, 6) AS cosine, CAST(n AS DOUBLE) AS n_matched, round(n / (n + nul), 6) AS frac_n_library, round(sl / (sl + sul), 6) AS frac_i_library, round(1 - 2 * acos(least(greatest(cs, 0), 1)) / pi(), 4) AS contrast, "
    "round(least(n ** 4 / (25 * greatest(gap, 2.220446049250313e-16) ** 0.25), 1000), 6) AS v1, round(ln(1 / (gap2 + sul2)), 6) AS scribe, round(mgap2 / n, 6) AS mse_mz, round(gap2 / n, 6) AS mse_intensity, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM ta JOIN tc USING (query_id)"
)
def sim_top(spark, d):
    """The measures over the library's five strongest peaks, of queries that match one of these."""
    s, a = sim.Aligned.on(fx.best(spark, d), "q_peaks", "l_peaks", "matches", 5)
    one = {"cosine": sim.cosine, "n_matched": sim.n_matched_peaks, "frac_n_library": sim.frac_n_peaks_library, "frac_i_library": sim.frac_intensity_library, "v1": sim.ms_for_id_v1, "scribe": sim.scribe_fragment_acc, "pearson": sim.pearsonr, "spearman": sim.spearmanr}
    return s.where(~a.none).select("query_id", *[r6(f(a), n) for n, f in one.items()], F.round(sim.spectral_contrast_angle(a), 4).alias("contrast"), r6(sim.mean_squared_error(a, "mz"), "mse_mz"), r6(sim.mean_squared_error(a, "intensity"), "mse_intensity"))


_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_BINS = vectorize.dimensions(11.0, 2010.0, 0.04)[0]


@query(
    f"WITH {ALIGNED}, s AS (SELECT query_id, n, (SELECT count(*) FROM peak WHERE peak.id = b.library_id) AS p FROM best b), t AS (SELECT query_id, p, unnest(range(n + 1, p + 1)) AS i FROM s), "
    f"u AS (SELECT query_id, -ln(sum(exp({_CHOOSE.format('p', 'i')} + {_CHOOSE.format(f'({_BINS} - p)', '(p - i)')} - {_CHOOSE.format(str(_BINS), 'p')}))) AS h FROM t GROUP BY 1) SELECT query_id, round(coalesce(least(h, 100), 100), 6) AS hypergeometric FROM s LEFT JOIN u USING (query_id)"
)
def sim_hypergeometric(spark, d):
    return similarity(spark, d, hypergeometric=lambda a: sim.hypergeometric_score(a, 11.0, 2010.0, 0.04))


@query()
def sim_kendall(spark, d):
    return similarity(spark, d, kendall=sim.kendalltau)


@query()
def similarity_features(spark, d):
    s, names = sim.with_features(fx.best(spark, d), "q_peaks", "l_peaks", "matches", 11.0, 2010.0, 0.04)
    return s.select("query_id", *[r6(F.col(n), n) for n in names])


@query(f"WITH {ALIGNED} SELECT b.query_id, round((q.precursor_mz - l.precursor_mz) * b.charge, 6) AS diff_da, round((q.precursor_mz - l.precursor_mz) / l.precursor_mz * 1e6, 3) AS diff_ppm, b.charge <= 2 AS charge_2, b.charge = 3 AS charge_3, b.charge = 4 AS charge_4, b.charge >= 5 AS charge_5, length(l.peptide) AS sequence_len, NOT l.is_decoy AS is_target FROM best b JOIN spec q ON q.id = b.query_id JOIN spec l ON l.id = b.library_id")
def precursor_features(spark, d):
    from ionweave.plans.search import charge_flags

    gap = F.col("q_precursor_mz") - F.col("l_precursor_mz")
    return fx.best(spark, d).select("query_id", r6(gap * F.col("charge"), "diff_da"), F.round(gap / F.col("l_precursor_mz") * 1e6, 3).alias("diff_ppm"), *[c.alias(f"charge_{n}") for n, c in charge_flags().items()], F.length("peptide").alias("sequence_len"), (~F.col("is_decoy")).alias("is_target"))


# --- false discovery rates ---------------------------------------------------------------------
def psms(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_decoy"))


def q_sql(groups: str) -> str:
    part = f"PARTITION BY {groups} " if groups else ""
    return f"WITH p AS (SELECT event_id, user_id, value AS score, event_type = 'error' AS is_decoy FROM events), c AS (SELECT *, count_if(is_decoy) OVER w AS d, count_if(NOT is_decoy) OVER w AS t FROM p WINDOW w AS ({part}ORDER BY score DESC RANGE UNBOUNDED PRECEDING)), f AS (SELECT *, CASE WHEN t > 0 THEN least((d + 1) / t, 1) ELSE 1 END AS f FROM c), q AS (SELECT *, min(f) OVER ({part}ORDER BY score RANGE UNBOUNDED PRECEDING) AS q FROM f)"


@query(q_sql("") + " SELECT event_id, round(CASE WHEN is_decoy THEN NULL ELSE q END, 6) AS q FROM q")
def qvalue_tdc(spark, d):
    return fdr.q_values(psms(spark, d)).select("event_id", r6(F.col("q"), "q"))


@query(q_sql("user_id") + " SELECT event_id, round(CASE WHEN is_decoy THEN NULL ELSE q END, 6) AS q FROM q")
def qvalue_grouped(spark, d):
    return fdr.q_values(psms(spark, d), groups=["user_id"]).select("event_id", r6(F.col("q"), "q"))


@query(q_sql("") + " SELECT count_if(NOT is_decoy AND q < 0.3) AS n_identified FROM q")
def count_identified(spark, d):
    from ionweave.plans.search import count_identified as count

    return count(fdr.q_values(psms(spark, d)), 0.3)


def open_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    narrow = fx.in_range(spark, d).select("id", "precursor_mz", "precursor_charge")
    return fx.queries_of(narrow), narrow


def open_levels(spark, d) -> DataFrame:
    """``(charge, q_mz, l_mz, n, mass_diff)`` of the open window's pairs, counted by their masses."""
    levels = cand.level_pairs(*open_sides(spark, d), fx.OPEN, "Da")
    return levels.withColumn("mass_diff", fdr.mass_difference(F.col("q_mz"), F.col("l_mz"), F.col("charge")) + 0.003)


OPEN_DIFF = f"od AS (SELECT q.id AS query_id, l.id AS library_id, (q.precursor_mz - l.precursor_mz) * q.charge + 0.003 AS mass_diff FROM spec q JOIN spec l ON q.charge = l.charge AND abs(q.precursor_mz - l.precursor_mz) * q.charge <= {fx.OPEN} WHERE q.id % 100 = 0 AND q.id <> l.id)"


@query(f"WITH {SPEC}, {OPEN_DIFF} SELECT CAST(round_even(mass_diff, 0) AS INT) AS nominal, CAST(least(floor((mass_diff - (round_even(mass_diff, 0) - 0.5)) * 100), 99) AS INT) AS bin, count(*) AS n FROM od GROUP BY ALL")
def mass_shift_histogram(spark, d):
    return fdr.shift_histogram(open_levels(spark, d), weight="n")


@query()
def mass_shift_groups(spark, d):
    """Groups are settled on the masses; then every pair gets its masses' group."""
    q, lib = open_sides(spark, d)
    groups = fdr.shift_groups(versions.cut(open_levels(spark, d)), least=5, weight="n").select("charge", "q_mz", "l_mz", "mass_group")
    q, lib = q.toDF("query_id", "q_mz", "charge"), lib.toDF("library_id", "l_mz", "charge")
    pairs = cand.with_each(q.join(groups, ["charge", "q_mz"]), lib, ["charge", "l_mz"], "library_id")
    return pairs.where("query_id != library_id").select("query_id", "library_id", "mass_group")


@query("SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 65 THEN -1 ELSE user_id END AS user_id FROM events")
def small_group_residual(spark, d):
    return fdr.residual_groups(table(spark, d, "events").select("event_id", "user_id"), "user_id", 65)


@query("WITH x AS (SELECT event_id, CASE WHEN value < 1 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) SELECT event_id, CASE WHEN isinf(v) THEN (SELECT max(v) FROM x WHERE NOT isinf(v)) ELSE v END AS v FROM x")
def impute_inf(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") < 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return fdr.impute_infinite(e, ["v"])


# --- cascade -----------------------------------------------------------------------------------
CASCADE = f"{ALIGNED}, acc AS (SELECT * FROM best WHERE n >= 8)"


@query(f"WITH {CASCADE} SELECT id FROM spec WHERE id % 100 = 0 AND id NOT IN (SELECT query_id FROM acc)")
def cascade_anti_join(spark, d):
    accepted = fx.best_with_peaks(spark, d).where(F.size("matches") >= 8).select(F.col("query_id").alias("id"))
    return fx.queries_of(fx.spectra(spark, d)).select("id").join(accepted, "id", "left_anti")


@query(f"WITH {CASCADE} SELECT query_id, 'std' AS level FROM acc UNION ALL SELECT id, 'open' FROM spec WHERE id % 100 = 0 AND id NOT IN (SELECT query_id FROM acc)")
def cascade_union(spark, d):
    accepted = fx.best_with_peaks(spark, d).where(F.size("matches") >= 8)
    rest = fx.queries_of(fx.spectra(spark, d)).select(F.col("id").alias("query_id")).join(accepted, "query_id", "left_anti")
    return accepted.select("query_id", F.lit("std").alias("level")).unionByName(rest.select("query_id", F.lit("open").alias("level")))


@query()
def cascade_search(spark, d):
    from ionweave.config import SearchConfig
    from ionweave.plans.search import search

    library = fx.spectra(spark, d).withColumn("id", F.col("id").cast("string"))
    cfg = SearchConfig(fx.STD, "Da", fx.FRAGMENT, fx.OPEN, "Da", min_mz_range=200.0, model="none", mode="bf", fdr=0.2, fdr_min_group_size=5, allow_peak_shifts=True)
    found = search(library.where(F.col("id").cast("long") % 100 == 0), library, cfg)
    return found.select("query_id", "library_id", "level", r6(F.col("score"), "score"), r6(F.col("q"), "q"), "mass_group")


# --- comparisons and summaries -----------------------------------------------------------------
A_SQL = "a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O')"
B_SQL = "b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000)"


def sets(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.where("o_orderstatus != 'O'").drop("o_orderstatus"), o.where("o_totalprice > 200000").drop("o_orderstatus")


@query(f"WITH {A_SQL}, {B_SQL} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice AS o_totalprice_a, b.o_totalprice AS o_totalprice_b FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def outer_compare(spark, d):
    return analysis.compare(*sets(spark, d), "o_orderkey")


@query(f"WITH {A_SQL}, {B_SQL} SELECT (SELECT count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS only_a, (SELECT count(*) FROM a WHERE o_orderkey IN (SELECT o_orderkey FROM b)) AS both, (SELECT count(*) FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS only_b")
def venn_counts(spark, d):
    return analysis.venn(*sets(spark, d), "o_orderkey")


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_join_labels(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name", "c_acctbal")


@query("SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id || '/' || x.event_type = e.user_id || '/' || e.event_type AND x.value > 99)")
def composite_key_membership(spark, d):
    key = F.concat_ws("/", "user_id", "event_type").alias("key")
    e = table(spark, d, "events")
    return e.select("event_id", key).join(e.where("value > 99").select(key).distinct(), "key", "left_semi").select("event_id")


@query("SELECT c_custkey, n_name, s_suppkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey")
def natural_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return cand.with_each(c.join(n, "nation"), s, ["nation"], "s_suppkey").select("c_custkey", "n_name", "s_suppkey")


@query("WITH p AS (SELECT c_nationkey AS k, count(*) AS psms FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS k, avg(s_acctbal) AS mean_time FROM supplier GROUP BY 1), u AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT n_name, psms, round(mean_time, 6) AS mean_time FROM p JOIN t USING (k) JOIN u USING (k)")
def stats_merge(spark, d):
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("psms"))
    t = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("mean_time"))
    return p.join(t, "k").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("n_name", "psms", r6(F.col("mean_time"), "mean_time"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev(value), 6) AS sd, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def engine_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value"), "mean"), r6(F.stddev("value"), "sd"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, quantile_cont(value, 0.5) AS median_diff, round(avg(value), 6) AS mean_diff, count(*) AS n FROM events GROUP BY 1")
def mass_group_stats(spark, d):
    return analysis.mass_group_stats(table(spark, d, "events"), "user_id", "value").withColumn("mean_diff", F.round("mean_diff", 6))


@query("SELECT w, round(quantile_cont(abs(value - round(value / w) * w), 0.5), 6) AS mad FROM events, (SELECT CAST(unnest([1.0, 0.4, 0.2, 0.1, 0.04, 0.02]) AS DOUBLE) AS w) GROUP BY 1")
def mad_grid(spark, d):
    grid = table(spark, d, "events").select("value", F.explode(F.array(*[F.lit(w) for w in (1.0, 0.4, 0.2, 0.1, 0.04, 0.02)])).alias("w")).withColumn("near", F.round(F.col("value") / F.col("w")) * F.col("w"))
    return analysis.absolute_deviation(grid, ["w"], "value", "near").withColumn("mad", F.round("mad", 6))


@query("WITH r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events) SELECT k, round(count_if(rank <= k) / count(*), 6) AS share FROM r, (SELECT unnest([1, 10, 50, 1024]) AS k) GROUP BY 1")
def rank_cdf(spark, d):
    from pyspark.sql.window import Window

    r = table(spark, d, "events").select(F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("rank"))
    return analysis.rank_cdf(r, "rank", [1, 10, 50, 1024]).withColumn("share", F.round("share", 6))


def trials(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("v"))


@query("WITH p AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS v, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) SELECT user_id, t, v FROM p WHERE m IS NULL OR v > m")
def pareto_frontier(spark, d):
    return analysis.pareto(trials(spark, d), "t", "v", "user_id")


@query(
    "WITH p AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS v, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events), f AS (SELECT user_id, t, v FROM p WHERE m IS NULL OR v > m), "
    "g AS (SELECT user_id, list_reduce(list([struct_pack(t := t, v := v)] ORDER BY t), lambda acc, x: CASE WHEN x[1].v > acc[-1].v AND x[1].t - acc[-1].t > 200.5 THEN list_concat(acc, x) ELSE acc END) AS k FROM f GROUP BY 1), u AS (SELECT user_id, unnest(k) AS r FROM g) SELECT user_id, r.t AS t, r.v AS v FROM u"
)
def pareto_gap(spark, d):
    return analysis.pareto_with_gap(trials(spark, d), "t", "v", "user_id", 200.5)


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN user_id END AS user_id FROM events")
def blank_repeats(spark, d):
    return analysis.blank_repeats(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"])


@query("SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'error') AS error FROM events GROUP BY 1")
def pivot_heatmap(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("SELECT l_linestatus AS mode, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM lineitem")
def result_counts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("flag"))
    everything = li.select(F.lit("all").alias("mode"), F.lit("all").alias("flag"))
    return li.unionByName(everything).groupBy("mode", "flag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'size' AS kind, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def wide_to_long(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "kind", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount / (l_discount + l_tax + 1) * 100, 6) AS io, round(l_tax / (l_discount + l_tax + 1) * 100, 6) AS ranking, round(1 / (l_discount + l_tax + 1) * 100, 6) AS other, round(l_quantity / 60, 6) AS minutes FROM lineitem")
def profile_split(spark, d):
    whole = F.col("l_discount") + F.col("l_tax") + 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("l_discount") / whole * 100, "io"), r6(F.col("l_tax") / whole * 100, "ranking"), r6(1 / whole * 100, "other"), r6(F.col("l_quantity") / 60, "minutes"))


@query("SELECT DISTINCT p_name AS peptide FROM part")
def distinct_peptides(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("peptide")).distinct()


@query("SELECT p_partkey, w, n, round(p_retailprice / w / n, 6) AS score FROM part, (SELECT CAST(unnest([1.0, 0.4, 0.2]) AS DOUBLE) AS w), (SELECT unnest([100, 400, 800]) AS n)")
def parameter_grid(spark, d):
    grid = spark.createDataFrame([(w, n) for w in (1.0, 0.4, 0.2) for n in (100, 400, 800)], "w double, n int")
    return table(spark, d, "part").select("p_partkey", "p_retailprice").join(F.broadcast(grid)).select("p_partkey", "w", "n", r6(F.col("p_retailprice") / F.col("w") / F.col("n"), "score"))  # nine settings


@query(
    "WITH e AS (SELECT event_id AS id, value % 7 AS mass, value AS score, user_id AS part FROM events), f AS (SELECT part, list_reduce(list([struct_pack(id := id, mass := mass)] ORDER BY score DESC, id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.mass - x[1].mass) <= 0.05)) > 0 THEN acc ELSE list_concat(acc, x) END) AS tops FROM e GROUP BY 1), "
    "t AS (SELECT part, unnest(tops) AS top, generate_subscripts(tops, 1) AS k FROM f) SELECT e.id, e.part, arg_min(top.id, k) AS leader FROM e JOIN t ON t.part = e.part AND abs(e.mass - top.mass) <= 0.05 GROUP BY 1, 2"
)
def greedy_mass_groups(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") % 7).alias("mass_diff"), F.col("value").alias("score"), F.col("user_id").alias("part"))
    return analysis.greedy_groups(e, 0.05).select("id", "part", "leader")


_RANKS = "r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events WHERE event_type <> 'error')"


def event_ranks(spark, d) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, d, "events").where("event_type != 'error'")
    return e.select(F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("rank"))


@query(f"WITH {_RANKS}, c AS (SELECT rank, count(*) AS n FROM r GROUP BY 1), d AS (SELECT rank, sum(n) OVER (ORDER BY rank) AS c FROM c) SELECT share, CAST(min(rank) AS BIGINT) AS k FROM d, (SELECT CAST(unnest([0.9, 0.95, 0.99]) AS DOUBLE) AS share) WHERE c >= share * (SELECT count(*) FROM r) GROUP BY 1")
def rank_thresholds(spark, d):
    return analysis.rank_thresholds(event_ranks(spark, d), "rank", [0.9, 0.95, 0.99])


@query(
    f"WITH {_RANKS}, m AS (SELECT log10(min(rank)) AS a, log10(max(rank)) AS b, count(*) AS total FROM r), p AS (SELECT CAST(least(floor((log10(rank) - a) / ((b - a) / 10)), 9) AS INT) AS bin FROM r, m), c AS (SELECT bin, count(*) AS n FROM p GROUP BY 1) "
    "SELECT bin, round(10 ** (a + (b - a) / 10 * bin), 6) AS low, round(10 ** (a + (b - a) / 10 * (bin + 1)), 6) AS high, n, round(sum(n) OVER (ORDER BY bin) / total, 6) AS share FROM c, m"
)
def rank_bins(spark, d):
    return analysis.rank_bins(event_ranks(spark, d), "rank", 10).withColumns({n: F.round(n, 6) for n in ("low", "high", "share")})


# --- strings -----------------------------------------------------------------------------------
@query("SELECT p_partkey, lower(regexp_extract(p_name, '^[^0-9]+')) || '|' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') AS key FROM (SELECT p_partkey, 'Part' AS p_name FROM part)")
def natural_sort(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(seq.natural_key(F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))), "|").alias("key")).orderBy("key")


@query("SELECT p_partkey, levenshtein(p_name, p_type)::DOUBLE AS edits, round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS share FROM part")
def levenshtein_compare(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.edit_distance(F.col("p_name"), F.col("p_type")).alias("edits"), r6(seq.edit_distance(F.col("p_name"), F.col("p_type"), True), "share"))


@query("SELECT p_partkey, replace(regexp_replace(p_type || '[' || p_size || ']', 'n?\\[[^\\]]*\\]-?', '', 'g'), 'I', 'L') AS plain FROM part")
def strip_modifications(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.plain(F.concat("p_type", F.lit("["), F.col("p_size").cast("string"), F.lit("]"))).alias("plain"))


@query("SELECT p_partkey, 'PEP' || '[+' || p_size || '.5]TIDE' AS proforma FROM part")
def mgf_proforma(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.mgf_to_proforma(F.concat(F.lit("PEP+"), F.col("p_size").cast("string"), F.lit(".5TIDE"))).alias("proforma"))


@query("SELECT p_partkey, substr('MEPTIDEK', 1, p_size % 8 + 1) || '[Oxidation]' || substr('MEPTIDEK', p_size % 8 + 2) AS proforma FROM part")
def sptxt_proforma(spark, d):
    mods = F.concat(F.lit("1/"), (F.col("p_size") % 8).cast("string"), F.lit(",M,Oxidation"))
    return table(spark, d, "part").select("p_partkey", seq.sptxt_to_proforma(F.lit("MEPTIDEK"), mods).alias("proforma"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'y' END AS ion_type, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_size END AS ion_index, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS charge FROM part")
def parse_annotation(spark, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("y"), n, F.lit("/0.02"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("y"), n, F.lit("^2/0.1"))).otherwise(F.concat(F.lit("y"), n, F.lit("-18/0.1")))
    return table(spark, d, "part").select("p_partkey", seq.fragment_annotation(text).alias("a")).select("p_partkey", "a.ion_type", "a.ion_index", "a.charge")


@query("WITH k(i, ion, code, name) AS (VALUES (0, '?', 0, '_'), (1, 'a', 1, 'a'), (2, 'b', 2, 'b'), (3, 'c', 3, 'c'), (4, 'x', 4, 'x'), (5, 'y', 5, 'y'), (6, 'z', 6, 'z'), (7, 'I', 7, 'I'), (8, 'm', 8, 'm'), (9, 'p', 9, 'p'), (10, 'r', 10, 'r')) SELECT p_partkey, code, name FROM part JOIN k ON i = p_size % 11")
def ion_type_codes(spark, d):
    ion = F.element_at(F.array(*[F.lit(x) for x in "?abcxyzImpr"]), F.col("p_size") % 11 + 1)
    return table(spark, d, "part").select("p_partkey", seq.encode_ion_type(ion).alias("code")).withColumn("name", seq.decode_ion_type(F.col("code")))


@query("SELECT event_id, CAST((event_id // 60) * 60 + event_id % 60 + 0.25 AS DOUBLE) AS seconds FROM events")
def log_times(spark, d):
    from ionweave.sources.text import seconds

    text = F.concat(F.lit("real\t"), F.expr("cast(event_id div 60 as string)"), F.lit("m"), (F.col("event_id") % 60).cast("string"), F.lit(".25s"))
    return table(spark, d, "events").select("event_id", r6(seconds(text), "seconds"))


# --- decoys, rescoring -------------------------------------------------------------------------
@query()
def decoy_library(spark, d):
    from ionweave.operators.decoy import with_decoys

    letters = F.upper(F.regexp_replace("peptide", "[^A-Za-z]|[BJXZbjxz]", ""))
    library = fx.in_range(spark, d).withColumns({"id": F.col("id").cast("string"), "peptide": letters, "is_decoy": F.lit(False)}).where(F.length("peptide") > 1)
    return with_decoys(library).select("id", "peptide", "is_decoy", F.size("peaks").alias("n"))


def scored_events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("ssm_id"), F.col("user_id").alias("query_id"), (F.col("event_type") == "error").alias("is_decoy"), F.col("value").alias("cosine"), F.log1p("value").alias("f1"), (F.col("user_id") % 10).cast("double").alias("f2"))


@query()
def rescore_svm(spark, d):
    from ionweave.operators.rescoring import rescore

    return rescore(scored_events(spark, d), ["cosine", "f1", "f2"], "svm", train_fdr=0.3, rounds=1).select("ssm_id", "is_decoy", r6(F.col("score"), "score"))


@query()
def rescore_rf(spark, d):
    """The default model: each fold searches the grid (here its bounded depths of 3 to 7, all weights)."""
    from ionweave.operators.rescoring import GRID, rescore

    grid = [s for s in GRID if s.depth in (3, 5, 7)]
    return rescore(scored_events(spark, d), ["cosine", "f1", "f2"], "rf", train_fdr=0.3, rounds=1, grid=grid).select("ssm_id", "is_decoy", r6(F.col("score"), "score"))


# --- files ------------------------------------------------------------------------------------
def file_spectra(spark, d) -> DataFrame:
    """Spectra in the schema of files, with a peptide of plain letters."""
    letters = F.concat(F.lit("PEP"), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL"))
    kind = "array<struct<mz:double,intensity:double,ion_type:string,ion_index:int,ion_charge:int>>"
    none = F.transform("peaks", lambda p: F.struct(p["mz"].cast("double"), p["intensity"].cast("double"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"))).cast(kind)
    return fx.spectra(spark, d).select(F.col("id").cast("string").alias("id"), F.col("precursor_mz").cast("double").alias("precursor_mz"), F.col("precursor_charge").cast("int").alias("precursor_charge"), (F.col("id") % 7 + 0.5).cast("double").alias("retention_time"), letters.alias("peptide"), "is_decoy", none.alias("peaks"))


def through_files(spark, d, write, read, name: str) -> DataFrame:
    path = f"{versions.shared_dir(spark)}/files-{uuid.uuid4().hex}/spectra{name}"
    write(file_spectra(spark, d), path)
    return read(spark, path)


def file_summary(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", r6(F.col("precursor_mz"), "precursor_mz"), F.col("precursor_charge").alias("charge"), *columns, F.size("peaks").alias("n"), r6(pre.total(pre.field(F.col("peaks"), "mz")), "sum_mz"), r6(pre.total(pre.field(F.col("peaks"), "intensity")), "sum_intensity"))


_LETTERS = "'PEP' || translate(CAST(id AS VARCHAR), '0123456789', 'ACDEFGHIKL')"


def file_sql(more: str = "", where: str = "") -> str:
    return f"WITH {SPEC}, {RAW} SELECT CAST(id AS VARCHAR) AS id, round(precursor_mz, 6) AS precursor_mz, charge{more}, count(*) AS n, round(sum(mz), 6) AS sum_mz, round(sum(intensity), 6) AS sum_intensity FROM raw JOIN spec USING (id) {where} GROUP BY id, precursor_mz, charge, is_decoy"


@query(file_sql(f", CAST(id % 7 + 0.5 AS DOUBLE) AS retention_time, {_LETTERS} AS peptide, is_decoy"))
def source_mgf(spark, d):
    return file_summary(through_files(spark, d, export.write_mgf, registry.read_queries, ".mgf"), "retention_time", "peptide", "is_decoy")


@query(file_sql(", CAST(id % 7 + 0.5 AS DOUBLE) AS retention_time"))
def source_mzml(spark, d):
    return file_summary(through_files(spark, d, export.write_mzml, registry.read_queries, ".mzML"), "retention_time")


@query(file_sql(", CAST(id % 7 + 0.5 AS DOUBLE) AS retention_time"))
def source_mzxml(spark, d):
    return file_summary(through_files(spark, d, export.write_mzxml, registry.read_queries, ".mzXML"), "retention_time")


@query(file_sql(f", {_LETTERS} AS peptide, is_decoy").replace("SELECT CAST(id AS VARCHAR) AS id, ", "SELECT "))
def source_sptxt(spark, d):
    return file_summary(through_files(spark, d, export.write_sptxt, registry.read_library, ".sptxt"), "peptide", "is_decoy").drop("id")


@query(file_sql(f", {_LETTERS} AS peptide, is_decoy"))
def source_splib(spark, d):
    return file_summary(through_files(spark, d, export.write_splib, registry.read_library, ".splib"), "peptide", "is_decoy")


@query(file_sql(f", {_LETTERS} AS peptide", "WHERE id % 100 = 0"))
def source_splib_ids(spark, d):
    """Spectra fetched by id: seeks to their places in the files."""
    wanted = fx.queries_of(table(spark, d, "part").select(F.col("p_partkey").alias("id")))
    return file_summary(through_files(spark, d, export.write_splib, lambda s, path: binary.read_splib_ids(s, path, wanted), ".splib"), "peptide")


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) || 'K' AS sequence FROM part")
def source_proteins(spark, d):
    path = f"{versions.shared_dir(spark)}/files-{uuid.uuid4().hex}/proteins.fasta"
    letters = F.concat(F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")), F.lit("K"))
    entry = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" made of a part\n"), F.substring(letters, 1, 5), F.lit("\n"), F.expr("substring(concat(upper(regexp_replace(p_name, '[^A-Za-z]', '')), 'K'), 6)"))
    table(spark, d, "part").select(entry).write.text(path)
    return text.read_proteins(spark, path)


@query(f"WITH {ALIGNED} SELECT CAST(query_id AS VARCHAR) AS psm, CAST(library_id AS VARCHAR) AS library, CAST(b.charge AS VARCHAR) AS charge, CAST(round(dot, 3) AS DOUBLE) AS score, s.is_decoy FROM best b JOIN spec s ON s.id = library_id")
def mztab_round_trip(spark, d):
    """Best matches written as mzTab in ordered parts, joined to one file and read back."""
    from ionweave.config import SearchConfig
    from ionweave.sources import mztab

    found = fx.best_with_peaks(spark, d).where(F.size("matches") > 0)
    found = found.withColumns({"query_id": F.col("query_id").cast("string"), "score": F.round("dot", 3), "q": F.lit(0.0), "retention_time": F.lit(None).cast("double"), "source_index": F.lit(0)})
    out = mztab.write(found, f"{versions.shared_dir(spark)}/files-{uuid.uuid4().hex}/best", SearchConfig(fx.STD, "Da", fx.FRAGMENT), "library", "queries")
    back = text.read_mztab(spark, out)
    return back.select(F.col("PSM_ID").alias("psm"), F.col("`opt_ms_run[1]_cv_MS:1003062_spectrum_index`").alias("library"), "charge", F.col("`search_engine_score[1]`").cast("double").alias("score"), F.col("`opt_ms_run[1]_cv_MS:1002217_decoy_peptide`").alias("is_decoy"))


@query(
    f"WITH {SPEC}, {PEAK}, a AS (SELECT *, max(intensity) OVER w AS top, count(*) OVER w AS n, max(mz) OVER w - min(mz) OVER w AS reach FROM peak JOIN spec USING (id) WINDOW w AS (PARTITION BY id)), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS place FROM a WHERE n >= 10 AND reach >= 250 AND intensity > top * 0.1), "
    f"c AS (SELECT *, count(*) OVER w AS m, max(mz) OVER w - min(mz) OVER w AS span FROM b WHERE place <= 50 WINDOW w AS (PARTITION BY id)) SELECT id, charge AS precursor_charge, count(*) AS n, round(sum(mz), 6) AS sum_mz, round(sum(51 - place), 6) AS ranks FROM c WHERE m >= 10 AND span >= 250 GROUP BY 1, 2"
)
def processed_store(spark, d):
    """The processed library of all parts from its store, which is built at the first call for a table."""
    from ionweave.config import SearchConfig
    from ionweave.plans.search import prepare

    cfg = SearchConfig(fx.STD, "Da", fx.FRAGMENT, min_intensity=0.1)
    path = f"{versions.shared_dir(spark)}/store-{hashlib.sha1(d.encode()).hexdigest()[:12]}"
    stored = prepare(lambda: fx.spectra(spark, d), cfg, path, versions.source_mark(spark, f"{d}/lineitem.parquet"), spark).spectra
    ranks = F.expr("aggregate(peaks, 0D, (a, p) -> a + p.intensity) / array_min(transform(peaks, p -> p.intensity)) * (51 - size(peaks))")
    return stored.select("id", "precursor_charge", F.size("peaks").alias("n"), r6(pre.total(pre.field(F.col("peaks"), "mz")), "sum_mz"), F.round(ranks, 6).alias("ranks"))


_MASS = " ".join(f"WHEN '{c}' THEN {m!r}" for c, m in seq.MONOISOTOPIC.items())


@query(
    f"WITH p AS (SELECT 'PEPTIDE' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACDEFGHILM') || 'K' AS peptide FROM part), m AS (SELECT peptide, length(peptide) AS n, list_sum(list_transform(string_split(peptide, ''), lambda c: CAST(CASE c {_MASS} END AS DOUBLE))) + {seq.WATER!r} AS mass FROM p), "
    f"g AS (SELECT *, unnest([2, 3]) AS charge FROM m), e AS (SELECT *, unnest([20, 35]) AS energy FROM g) SELECT peptide || '/' || charge || '/' || energy AS id, round(mass / charge + {seq.PROTON!r}, 6) AS precursor_mz, charge, CAST(2 * (n - 1) AS INT) AS n, round((n - 1) * (mass + 2 * {seq.PROTON!r}), 2) AS sum_mz, round(2 * list_sum(list_transform(range(1, n), lambda i: exp(-energy * i / 1000.0))), 6) AS sum_intensity FROM e"
)
def predicted_library(spark, d):
    """Proteins written as FASTA, digested, predicted in batches for two charges and two collision energies."""
    path = f"{versions.shared_dir(spark)}/files-{uuid.uuid4().hex}/proteins.fasta"
    letters = F.concat(F.lit("PEPTIDE"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACDEFGHILM"), F.lit("K"))
    table(spark, d, "part").select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit("\n"), letters)).write.text(path)
    return file_summary(text.read_fasta(spark, path, (2, 3), (20, 35), batch_size=250)).withColumn("sum_mz", F.round("sum_mz", 2))


@query(similar_sql(cosine="ql", contrast="1 - 2 * acos(least(greatest(ql, 0), 1)) / pi()", scribe="ln(1 / (gap2 + sul2))", n_matched="CAST(n AS DOUBLE)", frac_n_query="n / (n + nuq)", frac_n_library="n / (n + nul)", frac_i_query="sq / (sq + suq)", frac_i_library="sl / (sl + sul)", mse_mz="mgap2 / n", mse_intensity="gap2 / n", manhattan="gap + suq + sul", euclidean="sqrt(gap2 + suq2 + sul2)", chebyshev="greatest(top, tuq, tul)"))
def sql_similarities(spark, d):
    """The similarities as SQL functions, in plain SQL over a view."""
    from ionweave.functions import sql

    sql.register(spark)
    names = {"cosine": "cosine", "contrast": "contrast_angle", "scribe": "scribe", "n_matched": "n_matched", "frac_n_query": "frac_n_query", "frac_n_library": "frac_n_library", "frac_i_query": "frac_intensity_query", "frac_i_library": "frac_intensity_library", "mse_mz": "mse_mz", "mse_intensity": "mse_intensity", "manhattan": "manhattan", "euclidean": "euclidean", "chebyshev": "chebyshev"}
    calls = ", ".join(f"round(similarity_{f}(q_peaks, l_peaks, matches), 6) AS {n}" for n, f in names.items())
    return spark.sql(f"SELECT query_id, {calls} FROM {{best}}", best=sql.plain_peaks(fx.best(spark, d)))
