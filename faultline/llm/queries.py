"""The registered queries of the operators: SPARK (name -> job) and ORACLE (name -> DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import align, fim, langid, lm_trie, minhash, mixture, order_minhash, partenum, pu_toxicity, reply_trees, secrets, url_filter, winnowing
from faultline.llm.shared import crc_mod, table

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


@register("op3_jaccard_join")
def _op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return partenum.jaccard_components(docs, 4, 85, 100).select("doc_id", "n_shingles", "component_id")


@register("op8_decontamination", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(w) - n + 2)) AS t(p)),
hit AS (SELECT r, item_id, p, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)""")
def _op8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return winnowing.contamination(docs, table(spark, d, "benchmark")).drop("text_key")


@register("op10_lm_scores")
def _op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 1)
    model = lm_trie.train_model(docs.where("NOT held_out"))
    out = lm_trie.score_texts(docs, model).withColumn("train_tokens", F.lit(model.total).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op1_language_id")
def _op1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = langid.fit(docs.where("NOT held_out").select("text", "lang"))
    out = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@register("op2_toxicity")
def _op2(spark: SparkSession, d: str) -> DataFrame:
    out = pu_toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


_SCAN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, p) AS (VALUES
  (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{24,}'),
  (3, '(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_id|[Aa]ccount)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]{3,}'),
  (4, '[A-Za-z0-9+/]{32,}'),
  (5, '[a-z]{2,10}://[A-Za-z0-9.:/_-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), (6, '\n[\x20\t]*\n')),
a AS (SELECT r, kind, regexp_extract_all(t, p) AS m, regexp_split_to_array(t, p) AS g FROM d, k WHERE regexp_matches(t, p)),
b AS (SELECT r, kind, i, m[i] AS m, length(g[i]) AS gap, length(m[i]) AS n FROM a, unnest(range(1, len(m) + 1)) AS u(i)),
c AS (SELECT *, CAST(sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM b),
e AS (SELECT r, kind, e - n AS s, e FROM c WHERE CASE kind
  WHEN 0 THEN length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 1 THEN n >= 20
  WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END),
f AS (SELECT *, sum(CASE WHEN kind = 6 THEN 1 ELSE 0 END) OVER w AS scope,
  max(CASE WHEN kind < 3 THEN e END) OVER w AS be, min(CASE WHEN kind < 3 THEN s END) OVER (PARTITION BY r ORDER BY s DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bs
  FROM e WINDOW w AS (PARTITION BY r ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT * FROM f WHERE NOT (kind IN (3, 4, 5) AND (coalesce(be > s, false) OR coalesce(bs < e, false)))),
n AS (SELECT *, max(CASE WHEN kind IN (1, 3) THEN e END) OVER f AS ie, max(CASE WHEN kind IN (0, 2, 4) THEN e END) OVER f AS se,
  min(CASE WHEN kind IN (1, 3) THEN s END) OVER b AS ib, min(CASE WHEN kind IN (0, 2, 4) THEN s END) OVER b AS sb
  FROM g WINDOW f AS (PARTITION BY r, scope ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY r, scope ORDER BY s DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN s - ie <= 200 OR ib - e <= 200 THEN 1 ELSE 0 END AS ni, CASE WHEN s - se <= 200 OR sb - e <= 200 THEN 1 ELSE 0 END AS ns FROM n),
x AS (SELECT r, kind, s, ['assign', 'access', 'hex', 'login', 'blob', 'endpoint'][kind + 1] || ':' || s || ':' || e AS txt FROM h
  WHERE kind < 3 OR (kind = 3 AND ns = 1) OR (kind = 4 AND ni = 1) OR (kind = 5 AND ni = 1 AND ns = 1)),
y AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS x, count(*) FILTER (kind > 2) AS w,
  string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(txt, ',' ORDER BY s, kind) AS every FROM x GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(every, '') AS spans, coalesce(w, 0) AS n_weak FROM d LEFT JOIN y USING (r)"""


@register("op4_secret_scan", _SCAN_SQL)
def _op4(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents").select("doc_id", "text")).drop("text_key", "found")


@register("op5_order_minhash")
def _op5(spark: SparkSession, d: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, d, "documents").select("doc_id", "text"))


@register("op6_mixture", r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS r FROM w),
x AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x, row_number() OVER (ORDER BY r, source NULLS LAST) AS no FROM r),
l AS (SELECT no AS lno, x AS lx FROM x WHERE x <= r ORDER BY no LIMIT 1),
t AS (SELECT source, source_size, least(CASE WHEN no >= lno THEN weight * lx ELSE cap END, cap) AS target FROM x LEFT JOIN l ON true),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || key), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""")
def _op6(spark: SparkSession, d: str) -> DataFrame:
    out = mixture.mixture(table(spark, d, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: (verdict, host, path) of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels whose pages make the list of blocked URLs.
LISTED_LABELS = ["casino-win", "cheap-pills", "free-bets"]
_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
) + " END"
_SORTED_RULES = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


@register("op7_url_filter", rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
a AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
  ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS args FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') ||
  regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical FROM a),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|\.)({'|'.join(LISTED_LABELS)})\.'))
SELECT page_id, host, path, {_RULE_SQL.format(*[h + p for _, h, p in _SORTED_RULES])} AS rule,
  coalesce({_RULE_SQL.format(*[v for v, _, _ in _SORTED_RULES])}, CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(canonical IN (SELECT canonical FROM l), false) AS listed FROM c""")
def _op7(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host().rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\."))
    out = url_filter.url_filter(pages, listed.select("url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def _escape_sql(c: str) -> str:
    c = f"replace({c}, '~', '~0')"
    for code, s in zip(reply_trees.CODES, reply_trees.CONTROL):
        c = f"replace({c}, '{s}', '~{code}')"
    return c


@register("op9_chat_format", f"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS no,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace({_escape_sql('role')}, chr(10), '~n')) + length({_escape_sql('text')}) + {len(reply_trees.START) + 1 + len(reply_trees.STOP)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""")
def _op9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = reply_trees.format_threads(rows.unionByName(more)).withColumn("turns", reply_trees.read_back()).withColumn("loss", reply_trees.masked_text())
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SPARK["pipeline"] = corpus_pipeline.run


@register("op11_token_alignment")
def _op11(spark: SparkSession, d: str) -> DataFrame:
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return align.link_scores(table(spark, d, "documents")).select(*cols)


@register("op12_near_duplicates")
def _op12(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


@register("op13_fill_in_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
x AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""")
def _op13(spark: SparkSession, d: str) -> DataFrame:
    out = fim.restored(fim.fill_in_middle(table(spark, d, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
