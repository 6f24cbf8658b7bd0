"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget goes down the tree: each node's share is divided among its children by weight, and no child gets more
than its capacity (its tokens times ``max_epochs``); what a child can't take goes to its siblings by weight, and only
what a whole subtree can't take goes to the siblings of its root. (Shares are given with subtree capacities known, so
one pass down does both.) A leaf with budget A and T tokens takes A div T whole epochs and a prefix of the next one.
An epoch's order is that of md5(seed, epoch, doc_id), and a prefix takes documents while their tokens fit the rest.

A prefix is found without ordering a leaf: tokens are summed by the first two hex digits of the key, the bucket in
which the prefix ends is summed by the next two, and only documents of that bucket of a bucket are put in order. The
result per leaf is one key, the last that is taken, so choosing documents needs no window and moves no text.

Defined results: null lang or source is the empty name; names without a weight have weight ``other``. Null or empty
texts have 0 tokens. Rows with equal doc_id have equal keys and are taken together. A null doc_id counts as the empty
name. An empty table gives no rows. Leaves without tokens take all their documents if they have any budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Weights:
    """Integer weights by name for the three levels."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def domain_by_number(source: Column, n: int = 3) -> Column:
    """A domain from a source's name: ``d`` and its trailing number modulo n, or ``d0``."""
    number = F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.concat(F.lit("d"), F.coalesce(F.pmod(number, F.lit(n)), F.lit(0)).cast("string"))


def _weight(level: str, names: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in names.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Divide ``budget`` (the parent's) among children with ``w`` and ``cap``: adds ``got``."""
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), child)
    n = nodes.withColumn("rank", F.row_number().over(order))
    n = n.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("full", F.col("cap").cast("decimal(38,0)") * F.col("open_w").cast("decimal(38,0)") <= F.col("left").cast("decimal(38,0)") * F.col("w"))
    n = n.withColumn("cut", F.min(F.when(~F.col("full"), F.struct("rank", "left", "open_w"))).over(by))
    return n.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(w * cut.left div cut.open_w as decimal(38,0))"))).drop("rank", "left", "open_w", "full", "cut")


def leaf_budgets(leaves: DataFrame, weights: Weights, budget: int | None, max_epochs: int) -> DataFrame:
    """leaf, tokens, docs, got. ``leaves`` has domain, lang, source, tokens, docs; budget None: all tokens."""
    long = "decimal(38,0)"
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(long))
    whole = F.lit(budget).cast(long) if budget is not None else F.sum("tokens").over(Window.partitionBy()).cast(long)
    domains = leaves.groupBy("domain").agg(F.sum("cap").cast(long).alias("cap"), F.sum("tokens").alias("tokens")).withColumn("budget", whole).withColumn("w", _weight("domain", weights.domain, weights.other))
    domains = _share(domains, [], "domain").select("domain", F.col("got").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").cast(long).alias("cap")).join(domains, "domain").withColumn("w", _weight("lang", weights.lang, weights.other))
    langs = _share(langs, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    out = leaves.join(langs, ["domain", "lang"]).withColumn("w", _weight("source", weights.source, weights.other))
    return _share(out, ["domain", "lang"], "source").select(*LEAF, "tokens", "docs", F.col("got").cast("long").alias("got"))


@dataclass(frozen=True)
class Mix:
    """A table per leaf: epochs (whole ones) and upto (the last key of the next one, empty if none)."""

    plan: DataFrame
    seed: int

    def choose(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with the columns of LEAF and doc_id) and ``copies``, for those that are taken."""
        out = docs.join(self.plan, LEAF)
        return out.withColumn("copies", (F.col("epochs") + F.when(key_of(self.seed, F.col("epochs"), F.col("doc_id")) <= F.col("upto"), 1).otherwise(0)).cast("long")).filter("copies > 0").drop("epochs", "upto")


def _before(df: DataFrame, part: str, start: Column) -> DataFrame:
    """Per leaf the first value of ``part`` whose tokens no longer fit ``rest``, and the tokens before it."""
    cum = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy(part)) + start
    return df.withColumn("cum", cum).filter(F.col("cum") > F.col("rest")).groupBy(*LEAF, "epochs", "rest").agg(F.min(F.struct(F.col(part), (F.col("cum") - F.col("tokens")).alias("base"))).alias("m")).select(*LEAF, "epochs", "rest", F.col(f"m.{part}").alias(part), F.col("m.base").alias("base"))


def plan_mix(ws: Workspace, meta: DataFrame, weights: Weights, budget: int | None = None, max_epochs: int = 4, seed: int = 17) -> Mix:
    """``meta`` has domain, lang, source, doc_id, n_tokens."""
    leaves = meta.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    got = leaf_budgets(leaves, weights, budget, max_epochs)
    none = F.col("tokens") == 0
    plan = got.select(*LEAF, F.when(none, F.lit(1)).otherwise(F.expr("got div nullif(tokens, 0)")).cast("long").alias("epochs"), F.when(none, F.lit(0)).otherwise(F.expr("got % nullif(tokens, 0)")).cast("long").alias("rest"))
    plan = ws.write(plan, "epochs")
    keyed = meta.join(plan.filter("rest > 0"), LEAF).withColumn("key", key_of(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumns({"a": F.substring("key", 1, 2), "b": F.substring("key", 3, 2)})
    one = _before(keyed.groupBy(*LEAF, "epochs", "rest", "a").agg(F.sum("n_tokens").alias("tokens")), "a", F.lit(0))
    two = keyed.join(one.select(*LEAF, "a", "base"), [*LEAF, "a"]).groupBy(*LEAF, "epochs", "rest", "a", "base", "b").agg(F.sum("n_tokens").alias("tokens"))
    two = two.withColumn("cum", F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("b")) + F.col("base")).filter("cum > rest")
    two = two.groupBy(*LEAF, "a").agg(F.min(F.struct("b", (F.col("cum") - F.col("tokens")).alias("base"))).alias("m")).select(*LEAF, "a", "m.b", "m.base")
    last = keyed.join(two, [*LEAF, "a", "b"]).groupBy(*LEAF, "rest", "a", "b", "base", "key").agg(F.sum("n_tokens").alias("tokens"))
    last = last.withColumn("cum", F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key")) + F.col("base"))
    # a key before every one of the bucket, if nothing of it fits
    upto = last.groupBy(*LEAF, "a", "b").agg(F.max(F.when(F.col("cum") <= F.col("rest"), F.col("key"))).alias("k")).select(*LEAF, F.coalesce("k", F.concat("a", "b")).alias("upto"))
    return Mix(ws.write(plan.join(upto, LEAF, "left").select(*LEAF, "epochs", F.coalesce("upto", F.lit("")).alias("upto")), "plan"), seed)


def _leaf_columns(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text").cast("string")).alias("n_tokens"))
    return rows.withColumn("domain", domain_by_number(F.col("source")))


def mix(docs: DataFrame, weights: Weights, **params) -> DataFrame:
    """Per document taken: doc_id, domain, lang, source, n_tokens, copies (in how many epochs it is)."""
    ws = Workspace(docs.sparkSession, "mix")
    meta = ws.write(_leaf_columns(docs), "meta")
    return plan_mix(ws, meta, weights, **params).choose(meta).select("doc_id", *LEAF, "n_tokens", "copies")


def mixed_documents(docs: DataFrame, weights: Weights, **params) -> DataFrame:
    """The rows of ``docs``, with all columns, each as often as it is taken; texts aren't shuffled."""
    ws = Workspace(docs.sparkSession, "mix")
    mixed = plan_mix(ws, ws.write(_leaf_columns(docs), "meta"), weights, **params)
    ws.drop("meta")
    names = {c: f"_{c}_" for c in docs.columns}  # extra columns may have the names used here
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.withColumns({"doc_id": F.col("_doc_id_").cast("long"), "lang": F.coalesce(F.col("_lang_").cast("string"), F.lit("")), "source": F.coalesce(F.col("_source_").cast("string"), F.lit(""))})
    rows = rows.withColumn("domain", domain_by_number(F.col("source")))
    taken = mixed.choose(rows).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(n).alias(c) for c, n in names.items()])
