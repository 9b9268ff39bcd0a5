"""Registered queries of the paper store, ranking, identity, sources, graphs and embeddings, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import udfs as U
from paperloom.operators import cluster, embed, graph, identity, store, topics
from paperloom.operators import coword as cw
from paperloom.plans import scholar
from paperloom.session import spread, table
from paperloom.sources import html_links, records
from paperloom.streaming import arrivals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Scores depend on a year, which is given, never the clock's.
YEAR = 2002


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as store rows: scores from their figures."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return o.select(
        n.cast("string").alias("store_id"), n.alias("n"), F.concat(F.lit("P"), n.cast("string")).alias("openalex_id"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citation_count"), F.when(n % 3 != 0, "V").alias("venue"),
        F.when(n % 4 == 0, (n % 101) / 100.0).alias("llm_score"), F.when(n % 3 != 1, (n % 97) / 96.0).alias("embedding_sim"), F.when(n % 5 < 2, (n % 53) / 52.0).alias("keyword_match_score"), F.when(n % 2 == 0, (n % 200 + 1).cast("int")).alias("search_rank"), (n % 7 == 0).alias("is_evaluated"),
    )


_P = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS store_id, o_orderkey AS n, year(o_orderdate) AS year, CAST(floor(o_totalprice / 1000) AS INT) AS c, CASE WHEN o_orderkey % 3 <> 0 THEN 'V' END AS venue,
 CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 101) / 100.0 END AS llm, CASE WHEN o_orderkey % 3 <> 1 THEN (o_orderkey % 97) / 96.0 END AS emb, CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey % 53) / 52.0 END AS kw,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 200 + 1 AS INT) END AS search_rank, o_orderkey % 7 = 0 AS is_evaluated FROM orders),
s AS (SELECT *, CASE WHEN c <= 0 THEN 0.0 ELSE 1 / (1 + exp(-1.8 * (ln(c + 1) - ln(51)))) END AS cen, CASE WHEN year >= 2002 THEN 1.0 ELSE 1 / (1 + exp(-0.7 * (year - 1995))) END AS rec, coalesce(emb, 0.02) AS rel, coalesce(kw, 0.0) AS k0 FROM p)"""
_ALL = {"relevance": 0.4, "keyword_match_score": 0.2, "centrality": 0.3, "recency": 0.3, "venue_score": 0.1, "llm_score": 0.25}


@register("importance_rank", f"""WITH {_P} SELECT store_id, round((0.4 + CASE WHEN rel >= 0.93 THEN 0.3 ELSE 0 END) * rel + coalesce((0.2 + CASE WHEN kw >= 0.93 THEN 0.3 ELSE 0 END) * kw, 0) + 0.3 * cen + 0.3 * rec + 0.1 * CASE WHEN venue IS NOT NULL THEN 0.5 ELSE 0 END + coalesce(0.25 * llm, 0), 6) AS importance_score FROM s""")
def importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.importance(_papers(spark, sf_dir), YEAR, _ALL).select("store_id", F.round("importance_score", 6).alias("importance_score"))


@register("multiplicative_rank", f"""WITH {_P} SELECT store_id, round(0.5 * ((1 + (0.7 + CASE WHEN k0 >= 0.93 THEN 0.3 ELSE 0 END) * k0) * (1 + (1.0 + CASE WHEN rel >= 0.93 THEN 0.3 ELSE 0 END) * rel) - 1) + 0.3 * cen + 0.2 * rec, 6) AS importance_score FROM s""")
def multiplicative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = store.importance(_papers(spark, sf_dir), YEAR, {"combined_relevance": 0.5, "centrality": 0.3, "recency": 0.2}, multiplicative=True)
    return scored.select("store_id", F.round("importance_score", 6).alias("importance_score"))


@register("tiered_rank", f"""WITH {_P}, t AS (SELECT *, CASE WHEN llm >= 0.3 THEN 1 WHEN emb >= 0.2 THEN 2 ELSE 3 END AS tier FROM s)
SELECT store_id, tier, CAST(row_number() OVER (ORDER BY tier, CASE tier WHEN 1 THEN llm WHEN 2 THEN emb ELSE 1.0 END DESC, CASE WHEN tier = 3 THEN round(rel, 9) ELSE 0 END DESC, CASE WHEN tier = 3 THEN round(cen, 9) ELSE 0 END DESC, CASE WHEN tier = 3 THEN round(rec, 9) ELSE 0 END DESC, store_id) AS INT) AS rank FROM t""")
def tiered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = store.importance(_papers(spark, sf_dir), YEAR)
    # Nine places: the last bits of exp differ between engines and would reorder ties.
    scored = scored.withColumns({c: F.round(c, 9) for c in ("relevance_score", "centrality_score", "recency_score")})
    return store.tiers(scored).select("store_id", "tier", F.col("rank").cast("int").alias("rank"))


@register("strategy_rank", f"""WITH {_P}, f AS (SELECT *, CASE WHEN search_rank > 0 THEN 1.0 / row_number() OVER (PARTITION BY coalesce(search_rank, 0) > 0 ORDER BY search_rank, store_id) END AS fb FROM s)
SELECT store_id, round(0.5 * coalesce(fb, 0.5 / 3) + 0.2 * rec + 0.3 * cen, 6) AS sort_score FROM f""")
def strategy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.strategy_sort(_papers(spark, sf_dir), YEAR, "balanced").select("store_id", F.round("sort_score", 6).alias("sort_score"))


@register("judge_queue", f"WITH {_P} SELECT store_id, search_rank FROM s WHERE NOT is_evaluated ORDER BY coalesce(search_rank, 9999), store_id LIMIT 100")
def judge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.judge_queue(_papers(spark, sf_dir).withColumn("importance_score", F.lit(None).cast("double")), 100).select("store_id", "search_rank")


@register("top_scored", f"WITH {_P} SELECT store_id, llm AS llm_score FROM s ORDER BY coalesce(llm, 0) DESC, store_id LIMIT 50")
def top_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_k(_papers(spark, sf_dir), 50, "llm_score").select("store_id", "llm_score")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals: users as papers; some come with one id, some with both."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("W"), u.cast("string"))).alias("openalex_id"), F.when((F.col("event_id") % 3 != 1) | (u % 2 == 0), u.cast("string")).alias("corpus_id"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"),
        (2000 + F.col("event_id") % 20).cast("int").alias("year"), F.lit("").alias("venue"), (F.col("event_id") % 100).cast("int").alias("citation_count"), (F.col("event_id") % 5).cast("int").alias("round"), F.when(F.col("event_type") == "click", "search").otherwise("citation").alias("source"),
        F.when(F.col("event_type") == "click", F.col("event_type")).alias("keywords"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("search_rank"),
    )


_ARRIVALS = """e AS (SELECT event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN 'W' || user_id END AS oa, CASE WHEN event_id % 3 <> 1 OR user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS cid, event_type FROM events),
f AS (SELECT oa, arg_min(coalesce(cid, oa), seq) AS first FROM e WHERE oa IS NOT NULL GROUP BY oa), x AS (SELECT e.*, coalesce(first, coalesce(cid, e.oa)) AS store_id FROM e LEFT JOIN f USING (oa) WHERE coalesce(cid, e.oa) IS NOT NULL)"""


@register("store_upsert", f"""WITH {_ARRIVALS} SELECT store_id, arg_min(oa, seq) FILTER (WHERE oa IS NOT NULL) AS openalex_id, 'T' || min(seq) AS title, CAST(2000 + min(seq) % 20 AS INT) AS year, count(*) AS n_discoveries, arg_min(CASE WHEN event_type = 'click' THEN 'search' ELSE 'citation' END, seq) AS first_source FROM x GROUP BY store_id""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history_columns(store.upsert(None, _arrivals(spark, sf_dir))).select("store_id", "openalex_id", "title", "year", F.col("n_discoveries").cast("bigint").alias("n_discoveries"), "first_source")


@register("store_stats", f"""WITH {_ARRIVALS}, h AS (SELECT store_id, arg_min(event_type, seq) AS t, min(seq) AS m FROM x GROUP BY store_id)
SELECT count(*) AS total_papers, count(*) FILTER (WHERE t = 'click') AS search_papers, count(*) FILTER (WHERE t <> 'click') AS citation_papers, avg(m % 100) AS avg_citation_count, (SELECT count(DISTINCT event_type) FROM x WHERE event_type = 'click') AS keywords_used, 3 AS current_round FROM h""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(store.upsert(None, _arrivals(spark, sf_dir)), 3)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources that know some customers each, by DOI or by openalex id."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    of = lambda rank, test, **cols: c.where(test).select(*[cols.get(k, F.lit(None).cast("string")).alias(k) for k in ("doi", "openalex_id", "s2_id", "s2_corpus_id", "title", "venue")], (F.lit(None).cast("int") if rank else F.lit(2000)).alias("year"), F.lit(rank).alias("source_rank"))
    doi, name = F.concat(F.lit("10.1/"), n.cast("string")), F.col("c_name")
    return (
        of(0, n % 2 == 0, doi=doi, title=name)
        .unionByName(of(1, n % 3 == 0, doi=doi, title=F.lit(""), venue=F.col("c_mktsegment")))
        .unionByName(of(2, n % 5 == 0, s2_id=n.cast("string"), title=name))
    )


_R = """r AS (SELECT '10.1/' || c_custkey AS doi, NULL AS s2_id, c_name AS title, NULL AS venue, 2000 AS year, 0 AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '10.1/' || c_custkey, NULL, '', c_mktsegment, NULL, 1 FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT NULL, CAST(c_custkey AS VARCHAR), c_name, NULL, NULL, 2 FROM customer WHERE c_custkey % 5 = 0)"""


@register("identity_merge", f"WITH {_R} SELECT coalesce('doi:' || doi, 's2_id:' || s2_id) AS key, min(doi) AS doi, min(s2_id) AS s2_id, arg_min(title, k) FILTER (WHERE title <> '') AS title, arg_min(venue, k) FILTER (WHERE venue IS NOT NULL) AS venue, coalesce(min(year), 0) AS year, count(*) AS n_records FROM r GROUP BY 1")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge(identity.keyed(_records(spark, sf_dir))).select("key", "doi", "s2_id", "title", "venue", F.coalesce("year", F.lit(0)).alias("year"), "n_records")


@register("title_anti_union", "SELECT id, title FROM (SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT min(c_custkey), arg_min(upper(c_name), c_custkey) FROM customer WHERE c_custkey % 3 = 0 AND lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 2 = 0) GROUP BY lower(c_name))")
def title_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return identity.merge_by_title(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("title", F.upper("title")))


@register("topic_hierarchy", "SELECT 'field' AS kind, 'fields/' || n_nationkey AS id, n_name AS name, 'topics.field.id:fields/' || n_nationkey AS filter FROM nation WHERE n_name = 'NATION_7'")
def topic_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(  # five rows
        F.col("n_nationkey").alias("rank"), F.concat(F.lit("T"), "n_nationkey").alias("topic_id"), F.concat("n_name", F.lit(" topics")).alias("topic"), F.concat(F.lit("subfields/"), "n_nationkey").alias("subfield_id"), F.concat(F.lit("sub "), "n_name").alias("subfield"),
        F.concat(F.lit("fields/"), "n_nationkey").alias("field_id"), F.col("n_name").alias("field"), F.concat(F.lit("domains/"), "r_regionkey").alias("domain_id"), F.col("r_name").alias("domain"),
    )
    return topics.resolve_topic(dim, "nation_7")


@register("url_classify", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages) SELECT page_id, CASE WHEN h LIKE '%github.io%' OR h LIKE '%github.com%' THEN 'github_pages' WHEN h LIKE '%sites.google.com%' THEN 'google_sites' WHEN h LIKE '%.edu%' OR h LIKE '%.ac.%' THEN 'institutional' WHEN h = '' THEN 'unknown' ELSE 'personal' END AS url_type FROM h""")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.url_type(F.col("url")).alias("url_type"))


@register("doi_normalise", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '10.5/' || c_name WHEN 1 THEN '10.5/' || c_name WHEN 2 THEN '10.5/' || c_name END AS doi, CASE c_custkey % 3 WHEN 0 THEN '2101.' || c_custkey WHEN 1 THEN '2101.' || c_custkey ELSE '2101.' || c_custkey END AS arxiv FROM customer""")
def doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = F.when(n % 4 == 0, F.concat(F.lit(" https://doi.org/10.5/"), "c_name")).when(n % 4 == 1, F.concat(F.lit("doi:10.5/"), "c_name", F.lit(" "))).when(n % 4 == 2, F.concat(F.lit("10.5/"), "c_name")).otherwise(F.lit(" "))
    number = F.concat(F.lit("2101."), n.cast("string"))
    arxiv = F.when(n % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("?x=1"))).when(n % 3 == 1, F.concat(F.lit("HTTP://arxiv.org/pdf/"), number, F.lit(".PDF"))).otherwise(F.concat(F.lit("arXiv:"), number, F.lit("#top")))
    return c.select(n.alias("id"), S.doi_key(raw).alias("doi"), S.arxiv_key(arxiv).alias("arxiv"))


@register("status_pivot", "SELECT CAST(year AS INT) AS year, count(*) FILTER (WHERE s = 'F') AS F, count(*) FILTER (WHERE s = 'O') AS O, count(*) FILTER (WHERE s = 'P') AS P FROM (SELECT year(o_orderdate) AS year, o_orderstatus AS s FROM orders) GROUP BY year")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import macro

    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("s")).agg(S.count().alias("n"))
    return macro.pivot(rows, "year", "s", "n", ["F", "O", "P"])


@register("link_extract")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_links.extract_links(table(spark, sf_dir, "pages"))


@register("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_links.html_text_udf(F.col("html")).alias("text"))


@register("cvf_listing")
def cvf_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html_links.extract_links(table(spark, sf_dir, "pages"))
    return html_links.cvf_listing(links.withColumn("href", F.when(F.col("pos") % 3 == 0, F.concat("href", F.lit("_paper.html"))).when(F.col("pos") % 3 == 1, F.concat("href", F.lit(".pdf"))).otherwise(F.col("href"))))


@register("csrankings_homepages", "SELECT c_name AS scholar_name, 'https://' || c_custkey || '.edu' AS homepage_url, 'institutional' AS url_type FROM customer WHERE c_custkey % 3 <> 0")
def csrankings_homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_name").alias("name"), F.lit("x").alias("affiliation"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("https://"), F.col("c_custkey").cast("string"), F.lit(".edu"))).alias("homepage"), F.lit("s").alias("scholarid"))
    return records.csrankings(c).select("scholar_name", "homepage_url", "url_type")


@register("hash_embed")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", U.hash_vector_udf(F.col("text"), 384).alias("embedding"))


@register("nearest_vectors", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS MATERIALIZED (SELECT id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS u FROM v),
c AS (SELECT q.id AS query_id, u.id, round(list_dot_product(q.u, u.u), 12) AS cosine FROM u AS q, u WHERE q.id % 100 = 0) SELECT query_id, id, round(cosine, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return embed.nearest(v, v.where("id % 100 = 0")).withColumn("cosine", F.round("cosine", 6))


@register("fuzzy_title")
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every part whose key is divisible by 100, in capitals, without its first letter, or with a mark behind it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"))
    number = F.col("id").cast("bigint")
    typed = F.when(number % 300 == 0, F.upper("title")).when(number % 300 == 100, F.expr("substring(title, 2)")).otherwise(F.concat("title", F.lit(" .")))
    asked = p.where(number % 100 == 0).select(F.col("id").alias("req"), F.lit(None).cast("string").alias("id"), "doi", "arxiv_id", typed.alias("title"))
    return identity.resolve(asked, p)


@register("cooccurrence_components", f"WITH RECURSIVE {scholar._BEST}, b AS (SELECT source AS a, target AS t FROM e UNION SELECT target, source FROM e), reach AS (SELECT DISTINCT a AS node, a AS seen FROM b UNION SELECT r.node, b.t FROM reach r JOIN b ON r.seen = b.a) SELECT node, min(seen) AS component FROM reach GROUP BY node")
def cooccurrence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(scholar.coword_edges(spark, sf_dir))


@register("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(scholar.coword_edges(spark, sf_dir))


@register("coword_clusters")
def coword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts, kept = scholar._best(spark, sf_dir)
    return cw.clusters(graph.communities(kept), counts, kept)


@register("lda_topics")
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cluster.lda(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), max_features=5000)
    return found.select("topic_id", "label", "doc_count", F.size("words").alias("n_words"))


@register("kmeans_topics")
def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))


@register("representative_docs")
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = cluster.lda(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), max_features=5000)
    return cluster.representatives(documents)


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan over a batch: watermarks don't matter there."""
    rows = arrivals.discoveries_by_window(table(spark, sf_dir, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals.sessions(table(spark, sf_dir, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("deep_search")
def deep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keyword rounds over the mapped works, judged by their citations, expanded and ranked."""
    from paperloom.model.driver_tables import tables
    from paperloom.operators import deep

    t = tables(spark, sf_dir)
    scores = t.works.select(F.col("work_id").cast("string").alias("store_id"), F.least(F.col("citations") / 500.0, F.lit(1.0)).alias("score"))
    return deep.deep_search(t, ["work 1", "work 22"], scores, YEAR).select("store_id", "title", "year", "citation_count", "importance_score")
