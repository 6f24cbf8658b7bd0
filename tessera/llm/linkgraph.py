"""URL filters: rules, and for urls without one the propagation of trust and distrust over links between hosts.

Hosts with allowed pages are trusted seeds, hosts with blocked pages are distrusted ones, each in proportion to the
number of such pages. Personalised PageRank carries trust along links and distrust against them (a host that links to
blocked ones is distrusted). A host is blocked when its distrust is over ``threshold`` percent of both together.
Scores are integers (billionths of a page, compared as shares of all trusted and distrusted pages), so the result
doesn't depend on the order of sums or, for the same links, on the table's size. Every step rounds up: what reaches a
host is never 0, however far away or diluted. Scores grow from 0 until none changes. A host without links to others
passes nothing on: what it has stays its own and isn't dealt out to all.

Everything is DataFrame operations. Links of a page to its own host carry nothing and are dropped before any shuffle;
links are counted per pair of hosts first. Joins deal out hosts with very many pages or links.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed by the
method, unless links say otherwise. Null html has no links; very long html is read whole. Repeated rows count and are
judged each; an empty table gives no rows. Other columns, whatever their names, are ignored. Rules of equal length: the
first in the list wins. Equal trust and distrust allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, join_spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAGE = 10**9  # the score of one page
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, like ``net/de/``) that fits, as a struct of rule and verdict, or null."""
    fits = []
    for k, (verdict, rule) in enumerate(rules):
        h, slash, p = rule.partition("/")
        ok = (host == h) | host.endswith("." + h)
        key = F.struct(F.lit(len(rule)).alias("n"), F.lit(-k).alias("k"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(ok & path.startswith(slash + p), key))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,k:int,rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: links from pages of one host to another host. ``pages`` has host and html."""
    targets = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1), lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x)))
    away = pages.select(F.col("host").alias("src"), targets.alias("all")).select("src", F.filter("all", lambda h: (h != F.col("src")) & (h != "")).alias("all"))
    return away.filter(F.size("all") > 0).select("src", F.explode("all").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(ws: Workspace, seeds: DataFrame, links: DataFrame, damping: int = 85) -> DataFrame:
    """host, trust, distrust when nothing changes any more. ``seeds`` has host, trust, distrust in billionths of a page.

    Scores start at 0, so that they only grow and the rounds end. Products are decimals of 38 digits.
    """
    links = ws.write(links, "pairs")
    n = links.count()
    out = links.groupBy("src").agg(F.sum("w").alias("out_w"), F.count("*").alias("members"))
    into = links.groupBy("dst").agg(F.sum("w").alias("in_w"), F.count("*").alias("members"))
    links = ws.write(join_spread(join_spread(links, out, ["src"], "dst", n), into, ["dst"], "src", n), "links")
    named = out.select(F.col("src").alias("host"), F.col("members").alias("n_out"), F.lit(0).cast("long").alias("n_in")).unionByName(into.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("n_out"), F.col("members").alias("n_in")))
    named = named.groupBy("host").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    seeds = ws.write(seeds.join(named, "host", "full").select("host", *map(zero, ("trust", "distrust", "n_out", "n_in"))), "seeds")
    wide = lambda x: f"cast({x} as decimal(20,0))"
    none = F.lit(0).cast("long")
    now, k = seeds.select("host", none.alias("trust"), none.alias("distrust"), "n_out", "n_in"), 0
    while True:
        givers = now.filter("n_out > 0").select(F.col("host").alias("src"), "trust", F.col("n_out").alias("members"))
        blamed = now.filter("n_in > 0").select(F.col("host").alias("dst"), "distrust", F.col("n_in").alias("members"))
        forth = join_spread(links, givers, ["src"], "dst", n).select(F.col("dst").alias("host"), F.expr(f"({wide('trust')} * w + out_w - 1) div out_w").alias("t"), none.alias("d"))
        back = join_spread(links, blamed, ["dst"], "src", n).select(F.col("src").alias("host"), none.alias("t"), F.expr(f"({wide('distrust')} * w + in_w - 1) div in_w").alias("d"))
        got = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        was = now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        step = seeds.join(got, "host", "left").select("host", *[F.expr(f"({100 - damping} * {wide(s)} + {damping} * {wide(f'coalesce({x}, 0)')} + 99) div 100").alias(s) for s, x in (("trust", "t"), ("distrust", "d"))], "n_out", "n_in")
        new = ws.write(step, f"round{k}")
        still = new.join(was, "host").filter("trust <> t0 or distrust <> d0").isEmpty()
        if k:
            ws.drop(f"round{k - 1}")
        now, k = new, k + 1
        if still:
            return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str]], damping: int = 85, threshold: int = 50) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    ws = Workspace(pages.sparkSession, "links")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    links = host_links(read)
    ruled = read.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", "r.verdict")
    ruled = ws.write(ruled, "ruled")
    per_host = ws.write(ruled.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"), F.count("*").alias("members")), "hosts")
    total = per_host.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "b", "members")]).first()
    seeds = per_host.select("host", (F.col("a") * PAGE).alias("trust"), (F.col("b") * PAGE).alias("distrust"))
    scores = propagate(ws, seeds, links, damping)
    share = lambda s, of, by: f"cast({s} as decimal(20,0)) * {max(total[of], 1) * by}"
    verdicts = scores.select("host", F.when(F.expr(f"{share('distrust', 'a', 100 - threshold)} > {share('trust', 'b', threshold)}"), "block").otherwise("allow").alias("by_host"))
    verdicts = verdicts.join(per_host.select("host", "members"), "host")
    return join_spread(ruled, verdicts, ["host"], "page_id", total["members"]).select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"))
