"""URL filters: rules on hosts and paths, and propagation over the link graph for the rest.

A rule judges the urls that it fits. Hosts with judged pages are seeds: personalised PageRank flows
from trusted seeds along host edges, distrust from blocked seeds against them. A host whose distrust
exceeds its trust by a threshold is blocked where no rule fits. Edges come from absolute links in the
pages; all sums are grouped before shuffles, and ranks are joined on the host. Rounds go on until no
new host is reached and the ranks together change by at most ``TOLERANCE``; a round shrinks a change
by the damping, so what is then left is at most damping / (1 - damping) times that.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is
allowed; a null page has no links; an empty table gives no rows; repeated rows get a row each; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import cut

#: Fixed values: (verdict, rule), host up to the slash, path from it.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The summed change of the ranks, which sum to one at most, at which they stand.
TOLERANCE = 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """A-Z lower-cased host, empty without ``://``."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list, a parameter."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight): links between different hosts."""
    link = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1)))
    links = pages.select(host_of(F.col(url_col)).alias("src"), link.alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, seed; sums to one) along ``edges`` (src, dst, share).

    Without ``rounds`` until it stands, looked at each fourth round.
    """
    rank = before = seeds.select("host", F.col("seed").alias("rank"))
    k = 0
    while rounds is None or k < rounds:
        if k % 4 == 3 and rounds is None:
            before = cut(rank)
            rank = before
        flow = edges.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        jump = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
        rank = flow.union(jump).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3:
            rank = cut(rank)
            if rounds is None and _stands(before, rank, tolerance):
                break
        k += 1
    return rank


def _stands(before: DataFrame, after: DataFrame, tolerance: float) -> bool:
    both = after.join(before.withColumnRenamed("rank", "was"), "host", "full")
    new, change = both.agg(F.sum(F.col("was").isNull().cast("int")), F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()
    return not new and (change or 0.0) <= tolerance


def url_filter(
    pages: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    rounds: int | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "by_rule": verdict})
    seeds = cut(judged.where("by_rule is not null").groupBy("host").agg(F.sum((F.col("by_rule") == "allow").cast("double")).alias("allow"), F.sum((F.col("by_rule") == "block").cast("double")).alias("block")))
    edges = cut(host_edges(pages, url_col, html_col))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    forward = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share"))
    backward = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("share"))
    linked = not edges.isEmpty()
    sums = seeds.agg(F.sum("allow"), F.sum("block")).first()

    def scores(kind: str, total: float | None, along: DataFrame) -> DataFrame:
        seed = seeds.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(total or 1.0)).alias("seed"))
        # Without an edge the ranks are the seeds, all but for the damping.
        return propagate(along, seed, damping, rounds) if linked else seed.select("host", ((1 - damping) * F.col("seed")).alias("rank"))

    trust = scores("allow", sums[0], forward).withColumnRenamed("rank", "trust")
    distrust = scores("block", sums[1], backward).withColumnRenamed("rank", "distrust")
    ranks = cut(trust.join(distrust, "host", "full"))
    both = judged.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return both.select(id_col, "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "trust", "distrust")
