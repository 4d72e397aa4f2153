"""URL rules and link-graph propagation over hosts.

Hosts trust the hosts they link to: personalised PageRank from trusted seeds runs along the edges.
Whoever links to a blocked host is suspect: the same walk from blocked seeds runs against them. The
seeds are the hosts whose pages the rules allow or block; hosts are judged by comparing both scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import stored

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
# Rounds end when they add at most this share to every score.
LEAST_CHANGE = 1e-6


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (verdict and name like ``net/``), or null."""
    fitting = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        fitting = F.when(fits, value) if fitting is None else fitting.when(fits, value)
    return fitting


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``src``, ``dst``, ``n``: how often pages of one host link to another one.

    Addresses with or without their scheme (``//host/``) name the host; relative ones go to the host of
    the page's first ``<base href>``, which is no link itself, or else stay on the page's own host.
    """
    full = r"(?i)^(https?:)?//"
    named = lambda address: F.when(address.rlike(full), url_host(F.regexp_replace(address, full, "http://"))).otherwise("")
    href = r"href\s*=\s*[\x22']?\s*([^\x22'\s<>]*)"
    base = F.regexp_extract(html, rf"(?i)<base\b[^>]*?\s{href}", 1)
    rest = F.when(base != "", F.regexp_replace(html, r"(?i)<base\b[^>]*>", "")).otherwise(F.col(html))
    linking = pages.filter(F.col(host) != "").select(F.col(host).alias("src"), named(base).alias("base"), rest.alias("rest"))
    links = linking.select("src", "base", F.explode(F.regexp_extract_all("rest", F.lit(f"(?i){href}"), F.lit(1))).alias("address"))
    relative = ~F.col("address").rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//)")
    pairs = links.select("src", F.when(relative, F.col("base")).otherwise(named(F.col("address"))).alias("dst")).filter("dst <> '' AND src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust``: both walks, started anew with probability 0.15 a step.

    ``seeds`` has ``host``, ``trust``, ``distrust`` (each column is scaled to a sum of 1). A walk ends
    at a host without further edges. Round k adds the walks of k links. Rounds stop when none adds more
    than 1e-6 of a host's own score, which holds from then on; so a newly reached host always brings
    another round, however light its seed is.
    """
    out_total = edges.groupBy("src").agg(F.sum("n").alias("t"))
    in_total = edges.groupBy("dst").agg(F.sum("n").alias("t"))
    forward = edges.join(out_total, "src").select(F.lit("trust").alias("walk"), F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("t")).alias("share"))
    backward = edges.join(in_total, "dst").select(F.lit("distrust").alias("walk"), F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("n") / F.col("t")).alias("share"))
    moves = stored(forward.unionByName(backward), "moves")
    kinds = F.array(*[F.struct(F.lit(k).alias("walk"), F.col(k).cast("double").alias("weight")) for k in ("trust", "distrust")])
    started = seeds.select("host", F.inline(kinds)).filter("weight > 0")
    totals = started.groupBy("walk").agg(F.sum("weight").alias("all"))
    base = stored(started.join(F.broadcast(totals), "walk").select("walk", "host", (F.col("weight") / F.col("all")).alias("seed")), "seeds")
    scores = base.select("walk", "host", *[((1 - DAMPING) * F.col("seed")).alias(c) for c in ("score", "added")])
    while True:
        moved = scores.filter("added > 0").join(moves, (moves["walk"] == scores["walk"]) & (moves["from"] == scores["host"]))
        received = moved.select(moves["walk"], F.col("to").alias("host"), F.lit(0.0).alias("score"), (DAMPING * F.col("added") * F.col("share")).alias("added"))
        parts = received.unionByName(scores.select("walk", "host", "score", F.lit(0.0).alias("added")))
        summed = parts.groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("added").alias("added"))
        scores = stored(summed.select("walk", "host", (F.col("score") + F.col("added")).alias("score"), "added"), "scores")
        if scores.filter(F.col("added") > LEAST_CHANGE * F.col("score")).isEmpty():
            break
    either = lambda k: F.sum(F.when(F.col("walk") == k, F.col("score")).otherwise(0.0)).alias(k)
    return scores.groupBy("host").agg(either("trust"), either("distrust"))


def judge(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Judge every row of ``pages`` by the rules, and where none fits by the scores of its host.

    Returns the columns of ``pages`` except ``html``, with ``host``, ``path``, ``rule``, ``verdict``,
    ``trust`` and ``distrust``; columns of ``pages`` with these names are replaced.

    A host's seed weights are its numbers of allowed and of blocked pages. A page without a rule
    is blocked if the distrust of its host exceeds its trust. Hosts that no walk reaches are
    allowed. Links and seeds combine per host pair before their shuffle, so a host with a third of
    all pages costs no more than another; the walks work on host edges alone.

    Null urls and urls without ``://`` have an empty host and path, no rule and no edges, and are
    allowed. Null and empty html has no links. Repeated rows count and are judged each. An empty
    table gives an empty table. General: the scoring tables of this library hold no pages.
    """
    made = {"host", "path", "rule", "verdict", "trust", "distrust", html} - {url}
    rest = [c for c in pages.columns if c not in made]
    packed = pages.select(F.struct(*rest).alias("_row"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    packed = packed.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    packed = packed.withColumn("fit", matching_rule(F.col("host"), F.col("path")))
    number = lambda v: F.sum((F.col("fit.verdict") == v).cast("long"))
    seeds = packed.filter("host <> ''").groupBy("host").agg(
        F.coalesce(number("allow"), F.lit(0)).alias("trust"), F.coalesce(number("block"), F.lit(0)).alias("distrust")
    )
    scores = propagated(seeds, stored(host_edges(packed, "host", "_html"), "host-edges"))
    scores = scores.withColumnRenamed("host", "s_host")
    joined = packed.drop("_html").join(scores, F.col("host") == F.col("s_host"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when(distrust > trust, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in rest],
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
