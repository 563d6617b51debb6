"""URL filters: rules first, then link-graph propagation over hosts.

Where no rule fits a url, its host is judged: personalised PageRank carries
trust from the hosts with allowed pages along links, and distrust from the hosts
with blocked pages against them.  Everything is DataFrame operations over
aggregated host edges; ranks are written each round, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Rounds that are one job, and whose ranks are written.
BLOCK = 4
#: Share of its own rank by which a host may still be off when walks end, and the most rounds.
TOLERANCE, ROUNDS = 1e-2, 400
#: A host without a rule is blocked if distrust has more than this share of its trust and distrust.
DISTRUST = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z folded; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? or #; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, action) of the longest rule that fits, else null.

    A rule "host/path" fits its host and all subdomains, if the url's path
    starts with its path.  Rules are few enough for one expression.
    """
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, hierarchy: bool = True) -> DataFrame:
    """(src, dst, weight) of pages (host, html): links to other hosts, counted.

    A relative link stays on its host and is no edge.  With ``hierarchy`` a host
    also points to its parent domain (down to two labels) and back, once, as
    pages of one site often link each other by relative links alone.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' and dst <> '' and src <> dst")
    edges = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if hierarchy:
        hosts = pages.select("host").unionByName(edges.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
        labels = F.split("host", r"\.")
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda k: F.struct(F.array_join(F.slice(labels, k, 64), ".").alias("src"), F.array_join(F.slice(labels, k + 1, 64), ".").alias("dst")))
        up = hosts.where(F.size(labels) > 2).select(F.inline(above)).distinct()
        both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
        edges = edges.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return edges


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): ranks of two personalised walks, settled at each host that they reach.

    seeds: (host, trust, distrust), both sums scaled to 1; trust follows edges,
    distrust goes against them.  Rank that reaches a host without edges is lost.
    Ranks start from what the seeds give in one round and only grow, so a host
    that a walk has just reached has the rank that the shortest ways give it.
    Walks end when the last BLOCK rounds have reached no new host, and have
    changed no host's rank by more than a share of it: what is left shrinks by
    the damping in each round, and is estimated at ``tolerance`` of each rank at
    most.  Walks that ``rounds`` rounds (in whole blocks) don't settle raise.
    """
    base = shared_dir(edges.sparkSession, "links")
    trust = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    distrust = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = written(trust.unionByName(distrust), f"{base}/edges")
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    both = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")), f"{base}/shares")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0")
    start = written(start, f"{base}/seeds")
    nothing = F.lit(0.0).alias("before")
    teleport = start.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("rank"), nothing)
    left = damping**BLOCK / (1 - damping**BLOCK)
    ranks = teleport.select("kind", "host", "rank")
    for k in range(0, rounds, BLOCK):
        new = ranks
        for step in range(BLOCK):
            moved = both.join(new.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("share") * F.col("rank")).alias("rank"), nothing)
            rows = moved.unionByName(teleport)
            if step == BLOCK - 1:
                rows = rows.unionByName(ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
            new = rows.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"))
        new = written(new, f"{base}/ranks{k}")
        change = new.where("rank > 0").agg(F.max((F.col("rank") - F.col("before")) / F.col("rank"))).first()[0] or 0.0
        ranks = new.where("rank > 0").select("kind", "host", "rank")
        if left * change <= tolerance:
            break
    else:
        raise ValueError(f"ranks still change by up to {change:.3g} of their size after {rounds} rounds")
    return ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for each page (page_id, url, html).

    Null urls, or urls without ://, have empty host and path and fit no rule; a
    host that neither walk reaches is allowed; repeated pages count as often as
    they occur; null html has no links; an empty table gives an empty result.
    """
    base = shared_dir(pages.sparkSession, "urls")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.action").alias("action")), f"{base}/rows")
    by_host = rows.where("host <> '' and action is not null").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust"))
    totals = by_host.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    seeds = by_host.select("host", (F.col("trust") / F.lit(float(max(totals.t or 0, 1)))).alias("trust"), (F.col("distrust") / F.lit(float(max(totals.d or 0, 1)))).alias("distrust"))
    edges = host_edges(pages.select(host(F.col("url")).alias("host"), "html"))
    ranks = propagate(edges, seeds)
    out = rows.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_graph = F.when(F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", by_graph).alias("verdict"), "trust", "distrust")
