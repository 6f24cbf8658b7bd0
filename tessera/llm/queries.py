"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, embed_dedup, linkgraph, maxent, mixing, quality, spm, token_files, topk
from tessera.llm.common import Workspace
from tessera.llm.minhash import near_duplicates

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MIX = mixing.Weights(domain={"d0": 5, "d1": 3, "d2": 2}, lang={"en": 5, "de": 2, "fr": 2, "es": 1}, source={"src0": 2})
MIX_EPOCHS, MIX_SEED = 4, 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of an installed vocabulary file: in the folder TESSERA_TOKENIZERS, or where the package of files is."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_inner_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, '{own}' text from values (0, 'user'), (1, 'assistant') v(t, r)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(Workspace(spark, "chat").write(chat.format_chats(turns), "formatted"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op6_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digest=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(_table(spark, sf_dir, "pages"), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_embedding_dedup, op2_inner_product_topk, op3_token_files, op4_chat_format, op5_source_mix, op6_maxent_score, op7_sentencepiece, op8_quality, op9_minhash_dedup, op10_url_filter)
    return {f.__name__: f for f in own}


# ---------------------------------------------------------------- SQL
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\]|TURN\])', '\1\\\2', 'g')) AS role_n,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\]|TURN\])', '\1\\\2', 'g')) AS text_n
  FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_n + CASE WHEN before IS NOT DISTINCT FROM role THEN length('[TURN]') ELSE length('<s>[INST][/INST]</s>') + role_n END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id, alone
"""


def _cases(column: str, names: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {other} END" if names else str(other)


def _share_sql(name: str, source: str, parent: str, child: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_o AS (
  SELECT *, row_number() OVER o AS rk, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow
  FROM {source} WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {child})
), {name}_c AS (
  SELECT *, min(CASE WHEN cap * ow > lft * w THEN rk END) OVER ({by}) AS cut FROM {name}_o
), {name} AS (
  SELECT *, CASE WHEN cap * ow <= lft * w THEN cap ELSE w * (max(CASE WHEN rk = cut THEN lft END) OVER ({by})) // (max(CASE WHEN rk = cut THEN ow END) OVER ({by})) END AS got FROM {name}_c
)"""


OP5_SQL = rf"""
WITH meta AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 3, 0) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {MIX_EPOCHS} AS HUGEINT) AS cap FROM meta GROUP BY ALL
), d0 AS (
  SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CAST((SELECT sum(tokens) FROM leaves) AS HUGEINT) AS budget, CAST({_cases("domain", MIX.domain, MIX.other)} AS HUGEINT) AS w FROM leaves GROUP BY domain
), {_share_sql("d1", "d0", "", "domain")}, l0 AS (
  SELECT domain, lang, CAST(sum(leaves.cap) AS HUGEINT) AS cap, any_value(d1.got) AS budget, CAST({_cases("lang", MIX.lang, MIX.other)} AS HUGEINT) AS w FROM leaves JOIN d1 USING (domain) GROUP BY domain, lang
), {_share_sql("l1", "l0", "domain", "lang")}, s0 AS (
  SELECT domain, lang, source, leaves.tokens, leaves.cap, l1.got AS budget, CAST({_cases("source", MIX.source, MIX.other)} AS HUGEINT) AS w FROM leaves JOIN l1 USING (domain, lang)
), {_share_sql("s1", "s0", "domain, lang", "source")}, plan AS (
  SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 1 ELSE got // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE got % tokens END AS rest FROM s1
), keyed AS (
  SELECT meta.*, epochs, rest, md5('{MIX_SEED}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM meta JOIN plan USING (domain, lang, source)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM keyed
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed WHERE epochs + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END > 0
"""


def _op10_sql(damping: int = 85, threshold: int = 50) -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.\-]*:)?//[^"''\s>]*)"""
    step = lambda seed, got: f"({100 - damping} * {seed} + {damping} * coalesce({got}, 0) + 99) // 100"
    return f"""
WITH RECURSIVE parsed AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, page_id, coalesce({lower.format(f"regexp_extract(url, '{url}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path, html FROM pages
), rules(verdict, rule, rhost, rpath) AS (VALUES {rules}
), fits AS (
  SELECT row_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_id
), ruled AS MATERIALIZED (SELECT row_id, page_id, host, path, rule, verdict FROM parsed LEFT JOIN fits USING (row_id)
), targets AS (
  SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS u FROM parsed
), named AS (
  SELECT src, {lower.format(f"regexp_extract(CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END, '{url}', 1)")} AS dst FROM targets
), counted AS (SELECT src, dst, count(*) AS w FROM named WHERE dst <> src AND dst <> '' GROUP BY src, dst
), links AS MATERIALIZED (
  SELECT src, dst, w, sum(w) OVER (PARTITION BY src) AS out_w, sum(w) OVER (PARTITION BY dst) AS in_w FROM counted
), hosts AS (
  SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM ruled GROUP BY host
), seeds AS MATERIALIZED (
  SELECT host, CAST(coalesce(a, 0) AS HUGEINT) * 1000000000 AS a, CAST(coalesce(b, 0) AS HUGEINT) * 1000000000 AS b FROM hosts FULL JOIN (SELECT src AS host FROM links UNION SELECT dst FROM links) USING (host)
), score(k, host, trust, distrust) AS (
  SELECT 0, host, CAST(0 AS HUGEINT), CAST(0 AS HUGEINT) FROM seeds
  UNION ALL
  SELECT k, host, t, d FROM (
    SELECT p.k + 1 AS k, s.host, {step('s.a', 'g.t')} AS t, {step('s.b', 'g.d')} AS d,
      bool_or({step('s.a', 'g.t')} <> p.trust OR {step('s.b', 'g.d')} <> p.distrust) OVER () AS moved
    FROM seeds s JOIN score p USING (host) LEFT JOIN (
      SELECT host, sum(t) AS t, sum(d) AS d FROM (
        SELECT dst AS host, (trust * w + out_w - 1) // out_w AS t, CAST(0 AS HUGEINT) AS d FROM links JOIN score ON src = host
        UNION ALL SELECT src, CAST(0 AS HUGEINT), (distrust * w + in_w - 1) // in_w FROM links JOIN score ON dst = host) GROUP BY host
    ) g ON g.host = s.host
  ) WHERE moved
), last AS (SELECT host, trust, distrust FROM score WHERE k = (SELECT max(k) FROM score))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN distrust * (SELECT greatest(sum(a), 1) FROM hosts) * {100 - threshold} > trust * (SELECT greatest(sum(b), 1) FROM hosts) * {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN last USING (host)
"""


OP2_SQL = """
WITH f AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM f q JOIN f c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _components_sql(rows: str, ids: str) -> str:
    """``named``: r and the least id reachable by ``links`` (a, b; both ways) for each row of a table of r and an id."""
    return f"""
reach(r, o) AS (SELECT r, r FROM {rows} UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o),
named AS (SELECT reach.r, min(x.{ids}) AS component_id FROM reach JOIN {rows} x ON x.r = reach.o GROUP BY reach.r)"""


OP1_SQL = f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
fit AS MATERIALIZED (
  SELECT r, list_transform(v, lambda x: coalesce(x, 0)) AS v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM rows
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.r AS a, y.r AS b FROM fit x JOIN fit y ON x.r <> y.r AND len(x.v) = len(y.v) WHERE list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.9
), degrees AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a), {_components_sql("rows", "vec_id")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN named USING (r) LEFT JOIN degrees USING (r)
"""


OP9_SQL = rf"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM rows
), sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r), shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes s ON s.r = b WHERE 100 * shared.n >= 85 * (p.n + s.n - shared.n)
), {_components_sql("rows", "doc_id")}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN named USING (r) LEFT JOIN sizes USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op2_inner_product_topk": OP2_SQL, "op4_chat_format": OP4_SQL, "op5_source_mix": OP5_SQL, "op9_minhash_dedup": OP9_SQL, "op10_url_filter": _op10_sql()}
