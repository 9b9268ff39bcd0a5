"""The registered queries of this subpackage: thin wrappers that derive the contract's columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, embedding_dedup, html_extract, near_duplicates, packing, pii, substring_dedup, tokens, toxicity, url_filter
from paperloom.llm.common import table

#: The listed entries of op2's contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("start", "start_word").withColumnRenamed("end", "end_word")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contract(judged)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_REST = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_OP2 = f"""
WITH u AS (SELECT page_id, {_REST} AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Every window against every window of its size; the operator winnows.
_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item AS (SELECT item_id, words, least(13, len(words)) AS k FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS gram FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM item)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, sizes WHERE len(words) >= k)),
found AS (SELECT doc_id, k, i, item_id FROM grams JOIN win USING (k, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
#: All pairs, and all that each vector reaches.
_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fit AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS n FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
ok AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda c: c / n) AS u FROM fit WHERE n > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.u) = len(b.u) THEN list_dot_product(a.u, b.u) >= 0.9 END),
reach AS (SELECT a AS node, a AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.node = vec_id
"""
#: All pairs of distinct sets that share a shingle, counted whole.
_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS grams FROM d),
class AS (SELECT md5(array_to_string(list_sort(grams), chr(10))) AS node, min(doc_id) AS rep, any_value(grams) AS grams, len(any_value(grams)) AS n FROM s WHERE len(grams) > 0 GROUP BY 1),
g AS (SELECT rep, n, unnest(grams) AS gram FROM class),
pair AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT a AS node, a AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node),
of AS (SELECT s.doc_id, len(s.grams) AS n, class.rep FROM s LEFT JOIN class ON len(s.grams) > 0 AND class.node = md5(array_to_string(list_sort(s.grams), chr(10))))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(least(m, rep), rep, doc_id) AS component_id, coalesce(least(m, rep), rep, doc_id) = doc_id AS kept
FROM of LEFT JOIN least ON least.node = rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _OP2, "op4_decontaminate": _OP4, "op7_embedding_dedup": _OP7, "op9_near_duplicates": _OP9}
