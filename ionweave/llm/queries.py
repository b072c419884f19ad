"""One registered query per corpus operator, with production parameters over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import crc_mod, table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.pitman_yor import score

    scored = score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ionweave.llm import bpe_codec

    both = bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


#: Rules of the URL filter's contract (fixed values).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.url_trust import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.simhash_mih import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm import rule_quality

    docs = table(spark, sf_dir, "documents")
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 3) != 1)
    scored = rule_quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= rule_quality.THRESHOLD).cast("int").alias("predicted"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ionweave.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.paragraph_sketch import edits

    return edits(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tails: a tenth of the documents repeat a period from a place on."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.periodic_runs import listed, periodic_runs, strongest

    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=_planted).withColumn("best", strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output"), "output_sha256"), sha(restored(F.col("output"), F.col("form")), "restored_sha256"))


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionweave.llm.norm_search import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_url_trust": op3_url_trust,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_token_count": op5_token_count,
    "op6_paragraph_sketch": op6_paragraph_sketch,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_html_crf": op9_html_crf,
    "op10_rule_quality": op10_rule_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_middle": op12_fill_middle,
    "op13_norm_search": op13_norm_search,
}

_SPACE = "[\\x20\\x09-\\x0D]+"
#: Words of each document with their places (``w``), with the contract's planted periods; crc32 goes bit by bit, as SQL has none.
_PERIODIC = f"""
    crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([(256 + ascii(c))::BIGINT], list_transform(range(8), lambda k: 0::BIGINT))))), lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS h FROM documents),
    raw AS (SELECT doc_id, h, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents JOIN crc USING (doc_id)),
    cutat AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) END AS a FROM raw),
    planted AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM cutat),
    w AS MATERIALIZED (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
    same AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
    island AS (SELECT doc_id, q, min(i) AS start, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS MATERIALIZED (SELECT doc_id, start, c + q AS length, min(q) AS period FROM island GROUP BY doc_id, start, c + q),
    drops AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, first(struct_pack(start := start, length := length, period := period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS b FROM run GROUP BY 1),
    left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN drops USING (doc_id, i) GROUP BY 1)"""

_CUTS = """
    u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x FROM documents),
    h AS (SELECT doc_id, t, list_transform(range(4), lambda k: CAST('0x' || substr(x, 1 + 8 * k, 8) AS UBIGINT)) AS h, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR t[-1] = chr(10) THEN 0 ELSE 1 END AS n, list_transform(string_split(t, chr(10)), lambda s: length(s) + 1) AS sizes FROM u),
    r AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS k1, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS k2 FROM h),
    c AS (SELECT doc_id, t, n, CAST(least(coalesce(list_sum(sizes[1:k1]), 0), length(t)) AS BIGINT) AS c1, CAST(least(coalesce(list_sum(sizes[1:k2]), 0), length(t)) AS BIGINT) AS c2, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)"""

#: DuckDB equivalents, for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": f"WITH {_PERIODIC} SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, b.length * 1000 // b.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN left_over USING (doc_id)",
    "op12_fill_middle": f"WITH {_CUTS} SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c1 END AS prefix_chars, CASE WHEN form <> 'plain' THEN c2 - c1 END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || substr(t, c2 + 1) || '<P>' || substr(t, 1, c1) || '<M>' || substr(t, c1 + 1, c2 - c1) ELSE '<P>' || substr(t, 1, c1) || '<S>' || substr(t, c2 + 1) || '<M>' || substr(t, c1 + 1, c2 - c1) END) AS output_sha256, sha256(t) AS restored_sha256 FROM c",
    "op13_norm_search": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (SELECT q.vec_id AS query_id, l.vec_id AS vec_id, CAST(list_inner_product(q.e, l.e) AS BIGINT) AS score FROM v q, v l WHERE q.vec_id % 50 = 0 AND q.vec_id <> l.vec_id) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5",
}
