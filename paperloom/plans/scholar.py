"""Registered queries of the scholarly analyses over the star-schema tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.model.driver_tables import SQL, tables
from paperloom.operators import authors, bibliometrics, citations, macro, readiness, search, topics
from paperloom.operators import coword as cw
from paperloom.operators import keyphrases as kp
from paperloom.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, mapped: bool = True):
    """Register a query of (spark, sf_dir); ``sql`` may use the tables of ``driver_tables`` as w, a, i, t, r."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {SQL}{sql}" if mapped else sql
        return f

    return keep


def _tables_query(name: str, f: Callable, sql: str | None) -> None:
    register(name, sql)(lambda spark, sf_dir: f(tables(spark, sf_dir)))


_tables_query("annual_impact", bibliometrics.annual_impact, """
, y AS (SELECT year, count(*) AS n_papers, CAST(sum(citations) AS BIGINT) AS total_citations FROM w WHERE year IS NOT NULL GROUP BY year)
SELECT year, n_papers, total_citations, total_citations / n_papers AS avg_citations,
       CAST(sum(n_papers) OVER (ORDER BY year) AS BIGINT) AS cumulative_papers, CAST(sum(total_citations) OVER (ORDER BY year) AS BIGINT) AS cumulative_citations,
       year = max(year) OVER () AND coalesce(n_papers < 0.5 * lag(n_papers) OVER (ORDER BY year), false) AS year_is_incomplete, year >= max(year) OVER () - 1 AS citation_lag_warning FROM y""")
_tables_query("growth_rate", bibliometrics.growth_rate, """
, y AS (SELECT year, count(*) AS n FROM w GROUP BY year), e AS (SELECT min(year) AS first_year, max(year) AS last_year, arg_min(n, year) AS a, arg_max(n, year) AS b FROM y)
SELECT first_year, last_year, CASE WHEN last_year > first_year THEN (power(b / a, 1.0 / (last_year - first_year)) - 1) * 100 END AS annual_growth_rate FROM e""")
_tables_query("overview_stats", bibliometrics.overview, """
SELECT count(*) AS total_papers, CAST(sum(citations) AS BIGINT) AS total_citations, avg(citations) AS avg_citations, quantile_cont(citations, 0.5) AS median_citations,
       quantile_cont(citations, 0.25) AS p25, quantile_cont(citations, 0.5) AS p50, quantile_cont(citations, 0.75) AS p75, quantile_cont(citations, 0.9) AS p90,
       min(year) AS first_year, max(year) AS last_year, count(*) FILTER (WHERE is_oa) AS open_access_count, (count(*) FILTER (WHERE is_oa)) / count(*) AS open_access_share FROM w""")
_tables_query("document_types", bibliometrics.document_types, "SELECT type, count(*) AS n_papers FROM w GROUP BY type")


def _ranked_sql(source: str, key: str, names: str, group: str, distinct: str, top: int) -> str:
    return f"""
, b AS ({source}), s AS (SELECT {key} AS id, {names}, {distinct} AS n_papers, CAST(sum(citations) AS BIGINT) AS total_citations FROM b GROUP BY {key}),
o AS (SELECT {key} AS id, citations, row_number() OVER (PARTITION BY {key} ORDER BY citations DESC) AS n FROM b), h AS (SELECT id, count(*) FILTER (WHERE citations >= n) AS h_index FROM o GROUP BY id)
SELECT s.id, {group}, n_papers, total_citations, total_citations / n_papers AS avg_citations, h_index FROM s JOIN h USING (id) ORDER BY n_papers DESC, total_citations DESC, id LIMIT {top}"""


_tables_query("top_authors_hindex", bibliometrics.top_authors, _ranked_sql("SELECT a.*, w.citations FROM a JOIN w USING (work_id)", "author_id", "min(author_name) AS name", "name", "count(DISTINCT work_id)", 20))
_tables_query("top_sources_hindex", bibliometrics.top_sources, _ranked_sql("SELECT * FROM w WHERE source_name <> ''", "source_id", "min(source_name) AS name, min(source_type) AS type", "name, type", "count(*)", 20))
_tables_query("topic_frequency", lambda t: bibliometrics.top_topics(t).withColumn("avg_score", F.round("avg_score", 6)), """
SELECT topic_id AS id, min(topic) AS name, count(*) AS frequency, count(*) / (SELECT count(*) FROM w) * 100 AS percentage, round(avg(score), 6) AS avg_score, CAST(sum(citations) AS BIGINT) AS total_citations, sum(citations) / count(*) AS avg_citations
FROM t JOIN w USING (work_id) GROUP BY topic_id ORDER BY frequency DESC, total_citations DESC, id LIMIT 30""")
_tables_query("top_cited", bibliometrics.top_papers, """
, f AS (SELECT *, row_number() OVER (ORDER BY citations DESC, pos) AS rank FROM w ORDER BY citations DESC, pos LIMIT 20),
n AS (SELECT work_id, string_agg(author_name, '; ' ORDER BY apos) FILTER (WHERE apos <= 5) || CASE WHEN count(*) > 5 THEN '; et al.' ELSE '' END AS authors FROM a WHERE work_id IN (SELECT work_id FROM f) GROUP BY work_id)
SELECT CAST(rank AS INT) AS rank, work_id AS id, title, coalesce(authors, '') AS authors, year, source_name AS source, citations AS cited_by_count FROM f LEFT JOIN n USING (work_id)""")

_KEYS = "k AS (SELECT DISTINCT work_id, {key} FROM i WHERE {key} IS NOT NULL), z AS (SELECT work_id, count(*) AS n FROM k GROUP BY work_id)"


def _macro_sql(key: str, weight: str, names: str, extra: str, top: int) -> str:
    ident = "id" if key == "institution_id" else key
    return f"""
, {_KEYS.format(key=key)}, q AS (SELECT k.*, {weight} AS weight, z.n, citations, year, pos FROM k JOIN z USING (work_id) JOIN w USING (work_id)),
s AS (SELECT {key}, sum(weight) AS n_papers, sum(citations * weight) AS total_citations, arg_min(year, pos) AS first_year, arg_max(year, pos) AS last_year, CAST(sum(n - 1) AS BIGINT) AS collaborator_count FROM q GROUP BY {key})
SELECT {key} AS {ident}, {names} round(n_papers, 6) AS n_papers, round(total_citations, 4) AS total_citations, round(total_citations / n_papers, 6) AS avg_citations, first_year, last_year, collaborator_count FROM s {extra} ORDER BY round(s.n_papers, 6) DESC, round(s.total_citations, 4) DESC, {key} LIMIT {top}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"n_papers": F.round("n_papers", 6), "total_citations": F.round("total_citations", 4), "avg_citations": F.round("avg_citations", 6)})


_INST = "JOIN (SELECT DISTINCT institution_id, institution, country_code FROM i) USING (institution_id)"
for _kind, _weight in (("full", "1.0"), ("fractional", "1.0 / z.n")):
    _tables_query(f"country_{_kind}", lambda t, c=_kind: _rounded(macro.countries(t, c)), _macro_sql("country_code", f"CAST({_weight} AS DOUBLE)", "", "", 30))
    _tables_query(f"institution_{_kind}", lambda t, c=_kind: _rounded(macro.institutions(t, c)), _macro_sql("institution_id", f"CAST({_weight} AS DOUBLE)", "institution AS name, country_code, '' AS type,", _INST, 30))
_tables_query("country_density", macro.density, """
SELECT country_code, count(DISTINCT institution_id) AS n_institutions, CAST(count(*) AS DOUBLE) AS n_papers FROM (SELECT DISTINCT work_id, institution_id, country_code FROM i) GROUP BY country_code""")
_tables_query("corresponding_scp_mcp", macro.corresponding, """
, m AS (SELECT i.work_id, i.apos, country_code, is_corresponding FROM i JOIN a ON i.work_id = a.work_id AND i.apos = a.apos), n AS (SELECT work_id, count(DISTINCT country_code) AS n, max(is_corresponding::INT) AS c FROM m GROUP BY work_id),
p AS (SELECT DISTINCT m.work_id, country_code, n FROM m JOIN n USING (work_id) WHERE (c = 1 AND is_corresponding) OR (c = 0 AND apos = 1))
SELECT country_code, count(*) FILTER (WHERE n <= 1) AS scp, count(*) FILTER (WHERE n > 1) AS mcp, count(*) AS total, (count(*) FILTER (WHERE n > 1)) / count(*) AS mcp_share FROM p GROUP BY country_code ORDER BY total DESC, country_code LIMIT 30""")
_EDGES = ", {keys} SELECT x.{key} AS source, y.{key} AS target, count(*) AS weight FROM k x JOIN k y ON x.work_id = y.work_id AND x.{key} < y.{key} GROUP BY ALL ORDER BY weight DESC, source, target LIMIT {top}"
_tables_query("country_edges", lambda t: macro.edges(t, "country_code"), _EDGES.format(keys=_KEYS.format(key="country_code"), key="country_code", top=150))
_tables_query("institution_edges", lambda t: macro.edges(t, "institution_id"), _EDGES.format(keys=_KEYS.format(key="institution_id"), key="institution_id", top=150))
_tables_query("edge_node_weights", lambda t: macro.node_weights(macro.edges(t, "institution_id")), "," + _EDGES.format(keys=_KEYS.format(key="institution_id"), key="institution_id", top=150)[1:].replace(" SELECT x", ", e AS (SELECT x", 1) + """)
SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY node""")
_tables_query("country_by_year", macro.country_by_year, f", {_KEYS.format(key='country_code')} SELECT year, country_code, count(*) AS n_papers FROM k JOIN w USING (work_id) GROUP BY ALL")
_tables_query("institution_by_year", macro.institution_by_year, f", {_KEYS.format(key='institution_id')} SELECT year, institution_id, count(*) AS n_papers FROM k JOIN w USING (work_id) GROUP BY ALL")
_COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_tables_query("country_year_pivot", lambda t: macro.pivot(macro.country_by_year(t), "year", "country_code", "n_papers", _COUNTRIES).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"), f", {_KEYS.format(key='country_code')} SELECT year, " + ", ".join(f"count(*) FILTER (WHERE country_code = '{c}') AS {c.replace(' ', '_')}" for c in _COUNTRIES) + " FROM k JOIN w USING (work_id) GROUP BY year")
_tables_query("macro_overview", macro.overview, """
, p AS (SELECT work_id, count(DISTINCT country_code) AS c, count(DISTINCT institution_id) AS n FROM i GROUP BY work_id)
SELECT count(*) AS records_with_institutions, count(*) FILTER (WHERE c = 1) AS single_country, count(*) FILTER (WHERE c > 1) AS multi_country, count(*) FILTER (WHERE n = 1) AS single_institution, count(*) FILTER (WHERE n > 1) AS multi_institution, (count(*) FILTER (WHERE c > 1)) / count(*) AS multi_country_share FROM p""")

_tables_query("author_roles", authors.roles, "SELECT author_id, count(DISTINCT work_id) AS n_papers, count(*) FILTER (WHERE is_first) AS first_author_papers, count(*) FILTER (WHERE is_last) AS last_author_papers, count(*) FILTER (WHERE is_corresponding) AS corresponding_author_papers FROM a GROUP BY author_id")
_AUTHOR_KEYS = "k AS (SELECT DISTINCT work_id, author_id FROM a)"
_tables_query("coauthor_edges", authors.coauthor_edges, _EDGES.format(keys=_AUTHOR_KEYS, key="author_id", top=300))
_tables_query("author_collaborators", authors.collaborators, f", {_AUTHOR_KEYS} SELECT x.author_id, count(DISTINCT y.author_id) AS collaborator_count FROM k x JOIN k y ON x.work_id = y.work_id AND x.author_id <> y.author_id GROUP BY x.author_id")
_tables_query("primary_affiliation", authors.primary_affiliation, """
, c AS (SELECT author_id, institution_id, min(institution) AS institution, min(country_code) AS country_code, count(*) AS n FROM a JOIN i ON a.work_id = i.work_id AND a.apos = i.apos GROUP BY ALL)
SELECT author_id, institution AS primary_institution, country_code AS primary_country, n AS n_listings FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, institution_id) AS q FROM c) WHERE q = 1""")
_tables_query("author_topics", authors.author_topics, ", k AS (SELECT DISTINCT work_id, author_id FROM a) SELECT author_id, topic_id, count(*) AS n FROM k JOIN t USING (work_id) GROUP BY ALL ORDER BY n DESC, author_id, topic_id LIMIT 300")
_tables_query("author_by_year", authors.by_year, ", k AS (SELECT DISTINCT work_id, author_id FROM a) SELECT author_id, year, count(*) AS n_papers, CAST(sum(citations) AS BIGINT) AS total_citations FROM k JOIN w USING (work_id) GROUP BY ALL")
_tables_query("author_landscape", authors.landscape, """
, p AS (SELECT author_id, work_id, max(author_name) AS name, max(citations) AS citations FROM a JOIN w USING (work_id) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY citations DESC) AS n FROM p),
s AS (SELECT author_id, max(name) AS name, CAST(sum(citations) AS BIGINT) AS total_citations, count(*) FILTER (WHERE citations >= n) AS corpus_h_index, count(*) AS n_papers FROM o GROUP BY author_id),
b AS (SELECT * FROM s ORDER BY n_papers DESC, total_citations DESC, author_id LIMIT 30), k AS (SELECT DISTINCT work_id, author_id FROM a),
c AS (SELECT x.author_id, count(DISTINCT y.author_id) AS collaborator_count FROM k x JOIN k y ON x.work_id = y.work_id AND x.author_id <> y.author_id GROUP BY 1),
f AS (SELECT author_id, min(institution) AS primary_institution, min(country_code) AS primary_country, count(DISTINCT institution_id) AS institution_count, count(DISTINCT country_code) AS country_count FROM a JOIN i ON a.work_id = i.work_id AND a.apos = i.apos GROUP BY 1),
q AS (SELECT author_id, count(DISTINCT topic_id) AS topic_count FROM a JOIN t USING (work_id) GROUP BY 1), g AS (SELECT author_id, count(*) FILTER (WHERE is_first) AS x, count(*) FILTER (WHERE is_last) AS y, count(*) FILTER (WHERE is_corresponding) AS z FROM a GROUP BY 1)
SELECT author_id AS id, name, n_papers, total_citations, total_citations / n_papers AS avg_citations, corpus_h_index, x AS first_author_papers, y AS last_author_papers, z AS corresponding_author_papers, coalesce(collaborator_count, 0) AS collaborator_count,
       coalesce(institution_count, 0) AS institution_count, coalesce(country_count, 0) AS country_count, coalesce(topic_count, 0) AS topic_count, coalesce(primary_institution, '') AS primary_institution, coalesce(primary_country, '') AS primary_country
FROM b JOIN g USING (author_id) LEFT JOIN c USING (author_id) LEFT JOIN f USING (author_id) LEFT JOIN q USING (author_id)""")

_tables_query("citation_overview", citations.overview, "SELECT count(*) AS total_papers, CAST(sum(citations) AS BIGINT) AS total_citations, avg(citations) AS avg_citations, max(citations) AS max_citations, count(*) FILTER (WHERE citations = 0) AS zero_citation_count, (SELECT count(DISTINCT work_id) FROM r) AS records_with_references, (count(*) FILTER (WHERE citations = 0)) / count(*) AS zero_citation_share FROM w")
_tables_query("citations_by_year", citations.citations_by_year, "SELECT year, count(*) AS n_papers, CAST(sum(citations) AS BIGINT) AS total_citations, max(citations) AS max_citations FROM w GROUP BY year")
_tables_query("reference_frequency", citations.reference_frequency, ", f AS (SELECT ref_id, count(*) AS frequency FROM r GROUP BY ref_id ORDER BY frequency DESC, ref_id LIMIT 100) SELECT CAST(row_number() OVER (ORDER BY frequency DESC, ref_id) AS INT) AS rank, ref_id AS referenced_work, frequency FROM f")
_DOMAIN = ", c AS (SELECT ref_id, count(DISTINCT work_id) AS n FROM r GROUP BY ref_id), d AS (SELECT w.work_id, title, year, citations, coalesce(n, 0) AS in_domain_citations, CASE WHEN citations > 0 THEN coalesce(n, 0) * power(coalesce(n, 0) / citations, 2) END AS in_domain_citation_score FROM w LEFT JOIN c ON w.work_id = c.ref_id)"
_score6 = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})
_tables_query("in_domain_score", lambda t: _score6(citations.in_domain(t), "in_domain_citation_score"), f"{_DOMAIN} SELECT * REPLACE (round(in_domain_citation_score, 6) AS in_domain_citation_score) FROM d")
_tables_query("network_stats", citations.network_stats, f"""{_DOMAIN}, e AS (SELECT count(*) AS n FROM r WHERE ref_id IN (SELECT work_id FROM w))
SELECT count(*) AS total_papers, count(*) FILTER (WHERE in_domain_citations > 0) AS papers_with_in_domain_citations, CAST(sum(in_domain_citations) AS BIGINT) AS total_in_domain_citations, (SELECT count(*) FROM r) AS total_references, (SELECT n FROM e) AS in_domain_references, (SELECT n FROM e) / (SELECT count(*) FROM r) AS in_domain_ratio FROM d""")
_CO = ", c AS (SELECT ref_id, count(DISTINCT work_id) AS co_citation_count, min(work_id) AS first_citing, max(work_id) AS last_citing FROM r GROUP BY ref_id HAVING count(DISTINCT work_id) >= 2), j AS (SELECT c.*, w.work_id IS NOT NULL AS in_store FROM c LEFT JOIN w ON c.ref_id = w.work_id)"
_tables_query("co_citation", citations.co_citation, f"{_CO} SELECT * FROM j")
# Works with even ids stand for those that a store already holds.
_tables_query("missing_references", lambda t: citations.missing_band(citations.co_citation(t).select("ref_id", "co_citation_count"), t.works.where("work_id % 2 = 0")), f"""{_CO}, m AS (SELECT ref_id, co_citation_count FROM j WHERE ref_id NOT IN (SELECT work_id FROM w WHERE work_id % 2 = 0)),
b AS (SELECT CASE WHEN count(*) < 680 THEN 3 WHEN count(*) < 2500 THEN 4 WHEN count(*) < 6800 THEN 5 WHEN count(*) < 14000 THEN 7 ELSE 10 END AS x FROM m) SELECT m.* FROM m, b WHERE co_citation_count BETWEEN x AND least(x + 6, 16)""")
# The star schema's parts are cited too often for the band above; the references of a collection of one type of works aren't.
_tables_query("missing_references_of_type", lambda t: citations.missing_band(citations.co_citation(citations.collection(t, F.col("type") == "1-URGENT")).select("ref_id", "co_citation_count"), t.works.where(F.col("type") == "1-URGENT")), f"""{_CO.replace("FROM r ", "FROM r WHERE work_id IN (SELECT work_id FROM w WHERE type = '1-URGENT') ")}, m AS (SELECT ref_id, co_citation_count FROM j WHERE ref_id NOT IN (SELECT work_id FROM w WHERE type = '1-URGENT')),
b AS (SELECT CASE WHEN count(*) < 680 THEN 3 WHEN count(*) < 2500 THEN 4 WHEN count(*) < 6800 THEN 5 WHEN count(*) < 14000 THEN 7 ELSE 10 END AS x FROM m) SELECT m.* FROM m, b WHERE co_citation_count BETWEEN x AND least(x + 6, 16)""")
_tables_query("references_of", lambda t: citations.references_of(t, t.works), """, d AS (SELECT DISTINCT work_id, ref_id FROM r WHERE work_id IN (SELECT work_id FROM w)), n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY ref_id) AS n FROM d)
SELECT n.work_id, n.ref_id, w.title, w.year, w.citations FROM n LEFT JOIN w ON n.ref_id = w.work_id WHERE n <= 50""")
_tables_query("citations_of", lambda t: citations.citations_of(t, t.works), """, d AS (SELECT DISTINCT ref_id AS cited_id, w.work_id, title, year, citations FROM r JOIN w USING (work_id) WHERE ref_id IN (SELECT work_id FROM w) AND citations >= 0)
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY citations DESC, work_id) AS n FROM d) WHERE n <= 100""")
_tables_query("seed_candidates", lambda t: _score6(citations.seed_candidates(t, 50, years=(1996, 2000)), "in_domain_citation_score", "ratio"), f"""{_DOMAIN} SELECT * REPLACE (round(in_domain_citation_score, 6) AS in_domain_citation_score), round(in_domain_citations / citations, 6) AS ratio FROM d
WHERE in_domain_citations >= 2 AND citations >= 1 AND year BETWEEN 1996 AND 2000 ORDER BY d.in_domain_citation_score DESC, in_domain_citations DESC, work_id LIMIT 50""")
_tables_query("topic_by_year", lambda t: topics.topic_by_year(t, 3), ", f AS (SELECT topic_id, count(*) AS n, sum(citations) AS c FROM t JOIN w USING (work_id) GROUP BY topic_id HAVING count(*) >= 2 ORDER BY n DESC, c DESC, topic_id LIMIT 3) SELECT year, topic_id, min(topic) AS topic, count(*) AS count FROM t JOIN w USING (work_id) WHERE topic_id IN (SELECT topic_id FROM f) GROUP BY ALL")
_tables_query("field_coverage", readiness.coverage, """
, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE title <> '') AS title, 0 AS abstract, count(year) AS year, count(*) FILTER (WHERE work_id IN (SELECT work_id FROM a)) AS authors, count(*) FILTER (WHERE work_id IN (SELECT work_id FROM i)) AS author_institutions, count(*) FILTER (WHERE source_name <> '') AS source,
count(*) FILTER (WHERE work_id IN (SELECT work_id FROM t)) AS topics, count(*) FILTER (WHERE work_id IN (SELECT work_id FROM r)) AS referenced_works FROM w)
SELECT field, CAST(records AS BIGINT) AS records, records / total * 100 AS coverage FROM (UNPIVOT (SELECT total, CAST(title AS BIGINT) AS title, CAST(abstract AS BIGINT) AS abstract, CAST(year AS BIGINT) AS year, CAST(authors AS BIGINT) AS authors, CAST(author_institutions AS BIGINT) AS author_institutions, CAST(source AS BIGINT) AS source, CAST(topics AS BIGINT) AS topics, CAST(referenced_works AS BIGINT) AS referenced_works FROM n)
ON title, abstract, year, authors, author_institutions, source, topics, referenced_works INTO NAME field VALUE records)""")
_tables_query("qa_summary", readiness.qa_summary, "SELECT count(*) AS n_works, min(year) AS first_year, max(year) AS last_year, count(*) AS missing_doi, count(DISTINCT type) AS n_types, (SELECT count(*) FROM a WHERE (work_id, apos) NOT IN (SELECT (work_id, apos) FROM i)) AS authorships_without_institution, (SELECT count(*) FROM a) AS n_authorships FROM w")
_REQUEST = search.WorksRequest(from_year=1996, to_year=2000, min_citations=50, country="ASIA", topic_ids=("ECONOMY",), limit=500)
_tables_query("search_filters", lambda t: search.search(t, _REQUEST).select("work_id", "year", "citations", "type", "is_oa"), """
SELECT work_id, year, citations, type, is_oa FROM w WHERE year BETWEEN 1996 AND 2000 AND citations >= 50 AND work_id IN (SELECT work_id FROM i WHERE country_code = 'ASIA') AND work_id IN (SELECT work_id FROM t WHERE topic_id = 'ECONOMY') ORDER BY citations DESC, work_id LIMIT 500""")

# Texts. The portable token pattern reads alike in both engines.
_STOP = ", ".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS)
_TOKENS = f"tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{T.PORTABLE_PATTERN}'), lambda x: x NOT IN ({_STOP})) AS w FROM documents)"
_GRAMS = f"{_TOKENS}, g AS (SELECT doc_id, unnest(w || [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) AS term FROM tok)"


def _low(term: str) -> str:
    words = f"list_filter(string_split_regex({term}, '[\\s-]+'), lambda x: x <> '')"
    inside = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    return f"(len({words}) = 0 OR len(list_filter({words}, lambda x: length(x) > 2)) = 0 OR len(list_filter({words}, lambda x: x IN {inside(T.TERM_MARKUP_TERMS)})) > 0 OR len(list_filter({words}, lambda x: x NOT IN {inside(T.BIBLIOMETRIC_TERMS)})) = 0)"


def _terms(spark: SparkSession, sf_dir: str, ngram: tuple[int, int] = (1, 1)) -> DataFrame:
    return cw.documents_terms(spread(table(spark, sf_dir, "documents")), F.col("text"), ngram, T.PORTABLE_PATTERN)


@register("term_frequency", f"WITH {_TOKENS}, g AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT term, count(*) AS count, count(DISTINCT doc_id) AS doc_count FROM g WHERE NOT {_low('term')} GROUP BY term", mapped=False)
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.term_counts(_terms(spark, sf_dir))


@register("ngram_terms", f"WITH {_GRAMS} SELECT term, count(*) AS count, count(DISTINCT doc_id) AS doc_count FROM g WHERE NOT {_low('term')} GROUP BY term HAVING count(*) >= 3", mapped=False)
def ngram_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.term_counts(_terms(spark, sf_dir, (1, 2))).where("count >= 3")


_BEST = f"{_TOKENS}, g AS (SELECT doc_id, unnest(w) AS term FROM tok), c AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS doc_count FROM g WHERE NOT {_low('term')} AND length(term) > 1 GROUP BY term HAVING count(*) >= 2), k AS (SELECT DISTINCT doc_id, term FROM g WHERE term IN (SELECT term FROM c)), e AS (SELECT x.term AS source, y.term AS target, count(*) AS weight FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 300)"


def _best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    terms = _terms(spark, sf_dir)
    counts = cw.allowed_terms(cw.term_counts(terms))
    return terms, counts, cw.edges(terms, counts)


@register("coword_edges", f"WITH {_BEST} SELECT * FROM e", mapped=False)
def coword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)[2]


@register("term_degree", f"WITH {_BEST}, d AS (SELECT term, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT source AS term, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY term) SELECT CAST(row_number() OVER (ORDER BY count DESC, doc_count DESC, term) AS INT) AS rank, term, count, doc_count, coalesce(degree, 0) AS degree, coalesce(weighted_degree, 0) AS weighted_degree FROM (SELECT * FROM c ORDER BY count DESC, doc_count DESC, term LIMIT 100) LEFT JOIN d USING (term)", mapped=False)
def term_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts, kept = _best(spark, sf_dir)
    return cw.term_table(counts, kept)


@register("term_by_year", f"WITH {_BEST} SELECT CAST(2000 + doc_id % 10 AS INT) AS year, term, count(*) AS count FROM g WHERE term IN (SELECT term FROM c) GROUP BY ALL", mapped=False)
def term_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, counts, _ = _best(spark, sf_dir)
    years = spread(table(spark, sf_dir, "documents")).select("doc_id", (F.lit(2000) + F.col("doc_id") % 10).cast("int").alias("year"))
    return cw.term_by_year(terms, years, counts)


@register("tfidf_terms", f"WITH {_TOKENS}, g AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok), f AS (SELECT term, count(*) AS df FROM g GROUP BY term), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, term, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf FROM g JOIN f USING (term), n WHERE df >= 5", mapped=False)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    found = _terms(spark, sf_dir).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.lit(1))
    return kp.tfidf(found, docs.count()).where("doc_frequency >= 5").select("doc_id", "term", F.round("tfidf_score", 6).alias("idf"))


@register("keyphrase_candidates")
def keyphrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kp.candidates(table(spark, sf_dir, "documents"), F.col("text"))


@register("keyphrases_tfidf")
def keyphrases_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kp.nonredundant(kp.tfidf(keyphrase_candidates(spark, sf_dir)))


@register("keyphrases_hash")
def keyphrases_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kp.nonredundant(kp.hash_ranked(kp.candidates(docs, F.col("text")), docs.select("doc_id", "text")))
