"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

A rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts with its own; the
longest fitting rule decides. Hosts of allowed pages are seeds of trust, hosts of blocked pages seeds of distrust,
each weighted by its pages. Trust spreads along links by personalised PageRank, distrust against them (who links to
blocked hosts is distrusted). A host is blocked if distrust is more than ``threshold`` of the two together; a host
that neither reaches is allowed.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Links of a host to
itself, relative ones included, carry nothing. Null pages have no links; rows that repeat count each; an empty table
gives an empty result. Columns other than id, url and html are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of absolute and protocol-relative links in HTML.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
Rule = tuple[str, str, str]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(F.col(url), "://") > 0, F.regexp_replace(F.col(url), r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equal ones the longer host, then block), else null."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))
    fits = [F.when(((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): on how many pages of a host stands a link to another. Pages are summed before they are shuffled."""
    linked = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    linked = F.split(F.translate(F.array_join(linked, " "), UPPER, LOWER), " ")  # a host has no space
    found = pages.filter(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.array_distinct(linked)).alias("dst"))
    return found.filter("dst <> src and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, rank): PageRank for each kind of ``edges`` (kind, src, dst, n) that restarts at ``seeds`` (kind,
    host, weight). Hosts without links give their rank back to the seeds. Ends when ranks move by less than
    ``tolerance`` in all, or after ``rounds``.

    Links are shares of their source from the start. A round is one join and one aggregation whose sums are formed
    before the shuffle; the driver sees two numbers a kind."""
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")))
    whole = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = seeds.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("seed"), F.lit(0).alias("out"))  # ``whole`` has a row a kind
    ends = shares.select("kind", "host", F.lit(0.0), F.lit(1)).union(shares.select("kind", "dst", F.lit(0.0), F.lit(0)))
    state = cut(start.union(ends).groupBy("kind", "host").agg(F.sum("seed").alias("seed"), F.max("out").alias("out")).withColumn("rank", F.col("seed")).withColumn("moved", F.lit(0.0)))
    for done in range(rounds + 1):
        seen = state.groupBy("kind").agg(F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0)).alias("idle"), F.sum("moved").alias("moved")).collect()
        if done == rounds or not seen or (done and sum(r["moved"] for r in seen) < tolerance):
            break
        sent = state.filter("rank > 0").join(shares, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("sent"))
        back = F.coalesce(*[F.when(F.col("kind") == r["kind"], F.lit(1 - damping + damping * r["idle"])) for r in seen])
        after = state.join(sent, ["kind", "host"], "left").withColumn("new", back * F.col("seed") + damping * F.coalesce("sent", F.lit(0.0)))
        state = cut(after.select("kind", "host", "seed", "out", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("moved")))
    return state.select("kind", "host", "rank")


def host_evidence(judged: DataFrame, **options) -> DataFrame:
    """(host, trust, distrust) from pages with host, html and the verdict of a rule or null."""
    seeds = judged.filter("verdict is not null").groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("weight"))
    links = cut(host_links(judged))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    ranks = personalised(both, seeds, **options)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(``id_col``, host, path, rule, verdict) of every page. Only the hosts to block are joined back to pages."""
    host, path = host_and_path(url_col)
    split = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    judged = split.withColumn("m", matched(rules)).select("id", "html", "host", "path", "m.rule", "m.verdict")
    blocked = host_evidence(judged.select("host", "html", "verdict"), **options).filter(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_links"))
    out = judged.drop("html").join(cut(blocked), "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit("allow")).alias("verdict"))
