"""URL filter by rules and by trust propagated over the links between hosts, in DataFrame functions only.

A rule (host, path) fits a URL whose host is the rule's or a subdomain and whose path starts with the
rule's; the longest fitting rule decides. Other URLs are judged by their host: personalised PageRank
spreads trust from hosts whose pages the rules allow along host edges, and distrust from hosts whose
pages they block along reversed edges; a host with more distrust than trust (times ``threshold``) is
blocked. A host starts with the shares of its pages that rules allow and block.

Links are absolute ``href`` targets; links within a host say nothing and are dropped; edges are
aggregated to one row for each pair of hosts before any join, so a hot host is one row a neighbour. The
walks are repeated until a step changes less than ``TOLERANCE`` of the mass, however long the chains of links are. Every seed
brings its own mass and none is scaled by the number of seeds, so more seeds of one kind don't weaken those of the other.
Where no page links to another host, hosts are judged by their own pages' shares alone.

A null URL or one without ``://`` has empty host and path; pages without a known host are allowed. Repeated rows
and ids each give their row and each count among their host's pages; whole pages are read for links, however long; other
columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import cut

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` (A-Z lower-cased) and ``path``."""
    at = F.locate("://", F.col(url))
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``rule`` and ``ruled``: the longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest is asked first
        name, verdict = F.when(fits(r), F.lit(r[1] + r[2])).otherwise(name), F.when(fits(r), F.lit(r[0])).otherwise(verdict)
    return df.withColumns({"rule": name, "ruled": verdict})


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(src, dst, n)``: pages of a host that link to another host."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    found = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(linked).alias("dst")).where("src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, mass)``: personalised PageRank of the seeds' mass along ``edges(src, dst, n)``; sums to the seeds' mass.

    A host without outgoing edges gives its mass back to the seeds. Steps go on until they change less than ``tolerance`` of the whole
    mass; as a step shrinks all differences by ``damping``, that takes a number of steps that depends on the tolerance alone.
    """
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    start = cut(seeds.where("mass > 0").select("host", (F.col("mass") / (total or 1.0)).alias("mass")))
    if not total or not edges.limit(1).count():
        return start.withColumn("mass", F.col("mass") * total)
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    sources = cut(share.select("src").distinct())
    mass, far = start, True
    while far:
        before = mass
        for _ in range(3):
            moved = share.join(mass, share.src == mass.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass"))
            back = mass.join(sources, mass.host == sources.src, "left_anti").agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("back"))
            home = start.select("host", (F.col("mass") * (1 - damping + damping * back.scalar())).alias("mass"))
            mass = moved.select("host", (F.col("mass") * damping).alias("mass")).unionByName(home).groupBy("host").agg(F.sum("mass").alias("mass"))
        mass = cut(mass)
        both = mass.unionByName(before.select("host", (-F.col("mass")).alias("mass"))).groupBy("host").agg(F.abs(F.sum("mass")).alias("change"))
        far = both.agg(F.sum("change")).first()[0] > tolerance
    return mass.select("host", (F.col("mass") * total).alias("mass"))


def judge_hosts(pages: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust, blocked)`` of every host that trust or distrust reaches."""
    count = lambda v: F.count(F.when(F.col("ruled") == v, 1)) / F.count("*")
    shares = cut(pages.where("host != ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("banned")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, shares.select("host", F.col("allowed").alias("mass")), tolerance=tolerance).withColumnRenamed("mass", "trust")
    distrust = propagate(back, shares.select("host", F.col("banned").alias("mass")), tolerance=tolerance).withColumnRenamed("mass", "distrust")
    both = trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.round("distrust", 12) > F.round(F.col("trust") * threshold, 12))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every page."""
    ruled = with_rule(with_host_path(pages.select("page_id", "url", "html")), rules)
    hosts = judge_hosts(ruled.select("host", "ruled"), cut(host_edges(ruled)), threshold, tolerance)
    joined = ruled.select("page_id", "host", "path", "rule", "ruled").join(hosts, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
