"""URL filtering by rules and by trust that spreads over the graph of hosts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import join_hot, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host, then the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url):
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _suffixes(host):
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _with_host(pages: DataFrame, table: DataFrame, most: int = 2000) -> DataFrame:
    """``pages`` with the columns of ``table`` (one row for each host) for their host, null where it has none."""
    return join_hot(pages, table, "host", most)


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and verdict to (page_id, host, path): the longest rule that fits, else null.

    ``rules`` has verdict and rule. Rules are joined to distinct hosts by the host's domains, so a page
    meets only the rules of its own chain of domains. Of equally long rules the first in order of text wins.
    """
    r = rules.select("verdict", "rule", F.regexp_extract("rule", r"^[^/]*", 0).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"))
    hosts = pages.select("host").distinct()
    fits = (
        hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        .join(r, "suffix")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("shorter"), "rule", "verdict", "start"))).alias("fits"))
    )
    first = F.filter("fits", lambda x: F.startswith(F.col("path"), x["start"]))
    return (
        _with_host(pages, fits)
        .withColumn("fit", F.get(first, F.lit(0)))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    )


def host_edges(links: DataFrame) -> DataFrame:
    """(src, dst) without repeats: ``links`` (host of the page, html) gives the hosts that pages link
    to, and each host is tied both ways to the domain above it (of two labels at least). Relative links
    stay on their host; each host has a link to itself, so no rank is lost at hosts without links."""
    out = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    linked = links.select("host", F.explode(F.array_distinct(out)).alias("to")).select(
        F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")
    )
    hosts = links.select(F.col("host").alias("src")).distinct().unionByName(linked.select(F.col("dst").alias("src"))).distinct()
    chain = hosts.select(F.explode(_suffixes(F.col("src"))).alias("src")).where("src like '%.%.%'").distinct()
    above = chain.select("src", F.regexp_extract("src", r"^[^.]*\.(.*)$", 1).alias("dst"))
    own = hosts.unionByName(above.select("src")).unionByName(above.select(F.col("dst").alias("src"))).select("src", F.col("src").alias("dst"))
    both = linked.unionByName(above).unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(own)
    return both.where("src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut: int = 4) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``seeds`` has host, allowed, blocked (weights). Trust starts from allowed seeds and follows
    links; distrust starts from blocked seeds and follows links backwards. Both run in the same
    joins, keyed by kind and host. Every ``cut`` rounds the ranks are written to the shared folder.
    """
    flows = edges.select(F.lit("t").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    degree = flows.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    flows = staged(flows.join(degree, ["kind", "src"]), "flows")
    total = seeds.agg(F.sum("allowed").alias("all_t"), F.sum("blocked").alias("all_d"))
    start = (
        seeds.crossJoin(F.broadcast(total))
        .select(
            F.col("host"),
            F.explode(
                F.array(
                    F.struct(F.lit("t").alias("kind"), (F.col("allowed") / F.col("all_t")).alias("seed")),
                    F.struct(F.lit("d").alias("kind"), (F.col("blocked") / F.col("all_d")).alias("seed")),
                )
            ).alias("s"),
        )
        .select("s.kind", "host", "s.seed")
        .where("seed > 0")
    )
    start = staged(start, "seeds")
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    for i in range(rounds):
        moved = flows.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") / F.col("degree")).alias("rank")
        )
        fresh = start.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("rank"))
        rank = moved.unionByName(fresh).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % cut == 0 or i + 1 == rounds:
            rank = staged(rank, "ranks")
    return rank.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "t", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.max(F.when(F.col("kind") == "d", F.col("rank"))), F.lit(0.0)).alias("distrust"),
    )


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits has the rule's verdict. Hosts of allowed and blocked pages are the seeds,
    weighted by those pages; any other page is blocked if its host's share of distrust,
    ``distrust / (trust + distrust)``, is over ``threshold``. Shares are rounded to nine digits so that
    the order of sums doesn't matter. Null urls and urls without ``://`` have an empty host and path,
    fit no rule, have no rank and are allowed. Repeated rows are judged each; an empty table gives an
    empty result. ``rules`` is a sequence of (verdict, rule) or a DataFrame with those columns.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule string")
    url = F.col(url_col).cast("string")
    known = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = staged(apply_rules(known, rules), "judged")
    edges = host_edges(pages.select(host_of(url).alias("host"), F.col(html_col).cast("string").alias("html")).where("host <> ''"))
    allowed, blocked = (F.sum(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)) for v in ("allow", "block"))
    seeds = judged.where("verdict is not null").groupBy("host").agg(allowed.alias("allowed"), blocked.alias("blocked"))
    ranks = propagate(edges, seeds)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    other = F.when(F.coalesce(share, F.lit(0.0)) > threshold, "block").otherwise("allow")
    return _with_host(judged, staged(ranks, "ranks")).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", other).alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust")
    )
