"""Named operations: list, describe, schema, run. Handlers take (tables, arguments) and return DataFrames or plain values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from paperloom.model.tables import Tables
from paperloom.operators import authors, bibliometrics, citations, cluster, coword, deep, embed, graph, identity, macro, readiness, search, store, topics
from paperloom.sources import records


@dataclass(frozen=True)
class Bound:
    """A parameter: its type, default, and inclusive bounds (of a number) or choices."""

    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def check(self, name: str, value: object) -> object:
        if value is None:
            return self.default
        if self.kind in (int, float) and not isinstance(value, (int, float)) or self.kind is str and not isinstance(value, str):
            raise ValueError(f"{name} must be {self.kind.__name__}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{name} must be from {self.low} to {self.high}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(self.choices)}")
        return value


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    handler: Callable
    parameters: dict[str, Bound] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def schema(self) -> dict:
        types = {int: "integer", float: "number", str: "string", bool: "boolean", tuple: "array", dict: "object"}
        fields = {n: {k: v for k, v in (("type", types[b.kind]), ("default", b.default), ("minimum", b.low), ("maximum", b.high), ("enum", list(b.choices) or None)) if v is not None} for n, b in self.parameters.items()}
        return {"type": "object", "properties": fields, "required": list(self.required), "additionalProperties": False}

    def run(self, tables: Tables, arguments: dict | None = None):
        given = arguments or {}
        if unknown := set(given) - set(self.parameters):
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        if missing := [n for n in self.required if given.get(n) is None]:
            raise ValueError(f"missing arguments: {', '.join(missing)}")
        return self.handler(tables, **{n: b.check(n, given.get(n)) for n, b in self.parameters.items()})


TOOLS: dict[str, Tool] = {}
_TOP = {"top": Bound(int, 30, 1, 500)}
_LEAST = {"min_count": Bound(int, 1, 1, 1000)}


def _add(name: str, description: str, handler: Callable, parameters: dict[str, Bound] | None = None, required: tuple[str, ...] = ()) -> None:
    TOOLS[name] = Tool(name, description, handler, parameters or {}, required)


def _coword(t: Tables, top: int, min_count: int, top_edges: int, ngram_max: int) -> dict:
    docs = embed.work_texts(t).select(F.col("work_id").alias("doc_id"), "text", "year")
    terms = coword.documents_terms(docs, F.col("text"), (1, ngram_max))
    counts = coword.allowed_terms(coword.term_counts(terms), min_count)
    kept = coword.edges(terms, counts, top_edges)
    members = graph.communities(kept)
    return {"terms": coword.term_table(counts, kept, top), "edges": kept, "clusters": coword.clusters(members, counts, kept), "dropped": coword.dropped_terms(terms)}


def _topic_modeling(t: Tables, backend: str, nr_topics: int | None) -> dict:
    return cluster.topic_model(embed.work_texts(t).select(F.col("work_id").alias("doc_id"), "text"), backend, **({"k": nr_topics} if nr_topics else {}))


def _search(t: Tables, **arguments):
    return search.search(t, search.WorksRequest(**{k: v for k, v in arguments.items() if v is not None}))


def _resolve(t: Tables, work_id: str | None, doi: str | None, title: str | None):
    if not (work_id or doi or title):
        raise ValueError("give an id, a DOI or a title")
    asked = t.works.sparkSession.createDataFrame([(0, work_id, doi, None, title)], "req int, id string, doi string, arxiv_id string, title string")
    known = t.works.select(F.col("work_id").cast("string").alias("id"), F.col("doi").cast("string") if "doi" in t.works.columns else F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), "title")
    found = identity.resolve(asked, known).where("id is not null").select(F.col("id").alias("_id"), F.element_at(F.array(*map(F.lit, ("id", "doi", "arxiv_id", "title"))), F.col("stage") + 1).alias("matched_by"), "score")
    return t.works.join(found, F.col("work_id").cast("string") == F.col("_id")).drop("_id")


def _conference(t: Tables, venue: str, year: int, query: str | None, source: str | None, source_collection_id: str | None, limit: int) -> dict:
    name = records.conference_source(venue, source, source_collection_id)
    rows = t.works.where((F.lower("source_name") == venue.lower()) & (F.col("year") == year))
    rows = rows.where(F.lower("title").contains(query.lower())) if query else rows
    return {"source": name, "request": records.dblp_query(venue, year, query) if name == "dblp" else None, "papers": rows.orderBy(F.desc("citations"), "work_id").limit(limit)}


def _deep(t: Tables, keywords: str, scores: dict | None, current_year: int, seeds: int, top: int):
    given = t.works.sparkSession.createDataFrame([(str(i), float(x)) for i, x in (scores or {}).items()], "store_id string, score double")
    return deep.deep_search(t, [k.strip() for k in keywords.split(";") if k.strip()], given, current_year, seeds, top)


_add("analysis.bibliometrics", "Totals, yearly impact, authors, sources, topics, top papers", lambda t, top: {"overview": bibliometrics.overview(t), "annual": bibliometrics.annual_impact(t), "growth": bibliometrics.growth_rate(t), "types": bibliometrics.document_types(t), "authors": bibliometrics.top_authors(t, top), "papers": bibliometrics.top_papers(t, top), "sources": bibliometrics.top_sources(t, top), "topics": bibliometrics.top_topics(t, top)}, _TOP)
_add("analysis.macro", "Countries and institutions with their links", lambda t, top, min_count, counting: {"overview": macro.overview(t), "countries": macro.with_countries(macro.countries(t, counting, top, min_count)), "institutions": macro.institutions(t, counting, top, min_count), "country_edges": macro.edges(t, "country_code"), "institution_edges": macro.edges(t, "institution_id"), "country_by_year": macro.with_countries(macro.country_by_year(t)), "density": macro.with_countries(macro.density(t, counting)), "corresponding": macro.with_countries(macro.corresponding(t, top))}, _TOP | _LEAST | {"counting": Bound(str, "full", choices=("full", "fractional"))})
_add("analysis.author_landscape", "Author roles, partners, affiliations, topics", lambda t, top, min_papers, focus: {"authors": authors.landscape(t, top, min_papers), "edges": authors.coauthor_edges(t), "topics": authors.author_topics(t), "by_year": authors.by_year(t)}, _TOP | {"min_papers": Bound(int, 1, 1, 1000), "focus": Bound(str)})
_add("analysis.coword", "Terms, their links and clusters", _coword, {"top": Bound(int, 100, 1, 1000), "min_count": Bound(int, 2, 1, 1000), "top_edges": Bound(int, 300, 1, 10_000), "ngram_max": Bound(int, 2, 1, 5)})
_add("analysis.topic_landscape", "Given topics and their years", lambda t, top, min_count: {"topics": topics.topic_landscape(t, top, min_count), "by_year": topics.topic_by_year(t, top, min_count)}, _TOP | {"min_count": Bound(int, 2, 1, 1000)})
_add("analysis.topic_modeling", "Topics learned from texts", _topic_modeling, {"backend": Bound(str, "lda", choices=("lda", "kmeans", "bertopic", "hdbscan")), "nr_topics": Bound(int, None, 2, 200)})
_add("analysis.citation_overview", "Citations, references, years", lambda t, top: {"overview": citations.overview(t), "papers": bibliometrics.top_papers(t, top), "by_year": citations.citations_by_year(t), "references": citations.reference_frequency(t)}, _TOP)
_add("analysis.inspect_readiness", "What the records allow", lambda t: {"coverage": readiness.coverage(t), "tools": readiness.tool_status(t)})
_add("analysis.recommend", "Which analyses to run", readiness.preflight)
_add("analysis.preflight", "Which analyses to run, and how", readiness.preflight)
_add("embeddings.embed_works", "Vectors of works", lambda t, backend, dimensions: embed.embed_works(t, backend=backend, dimensions=dimensions), {"backend": Bound(str, "hash"), "dimensions": Bound(int, 384, 8, 4096)})
_add("works.search", "Works by constraints", _search, {"from_year": Bound(int), "to_year": Bound(int), "min_citations": Bound(int, None, 0), "max_citations": Bound(int, None, 0), "country": Bound(str), "query": Bound(str), "limit": Bound(int, 100, 1, 10_000)})
_add("works.get", "One work by id", lambda t, work_id: t.works.where(F.col("work_id").cast("string") == work_id).limit(1), {"work_id": Bound(str)}, ("work_id",))
_add("authors.search", "Authors by name", lambda t, name, top: search.author_candidates(t, name, top), {"name": Bound(str), "top": Bound(int, 10, 1, 100)}, ("name",))
_add("authors.profile", "One author's figures", lambda t, author_id: authors.roles(t).where(F.col("author_id").cast("string") == author_id), {"author_id": Bound(str)}, ("author_id",))
_add("authors.from_work", "Authors of a work", lambda t, work_id, position: search.authors_of(t, work_id, position), {"work_id": Bound(str), "position": Bound(int, None, 1)}, ("work_id",))
_add("citations.references", "What a work cites", lambda t, work_id, limit: citations.references_of(t, t.works.where(F.col("work_id").cast("string") == work_id), limit), {"work_id": Bound(str), "limit": Bound(int, 1000, 1, 1000)}, ("work_id",))
_add("citations.citations", "What cites a work", lambda t, work_id, limit: citations.citations_of(t, t.works.where(F.col("work_id").cast("string") == work_id), most_per_work=limit), {"work_id": Bound(str), "limit": Bound(int, 1000, 1, 1000)}, ("work_id",))
_add("citations.lookup", "Both directions of a work", lambda t, work_id, limit: {"references": TOOLS["citations.references"].run(t, {"work_id": work_id, "limit": limit}), "citations": TOOLS["citations.citations"].run(t, {"work_id": work_id, "limit": limit})}, {"work_id": Bound(str), "limit": Bound(int, 1000, 1, 1000)}, ("work_id",))
_add("citations.resolve", "The work that an id, DOI or title means", _resolve, {"work_id": Bound(str), "doi": Bound(str), "title": Bound(str)})
_add("conferences.papers", "A venue's works of a year", _conference, {"venue": Bound(str), "year": Bound(int), "query": Bound(str), "source": Bound(str), "source_collection_id": Bound(str), "limit": Bound(int, 100, 1, 10_000)}, ("venue", "year"))
_add("search.deep", "Keyword rounds (joined by ';'), judged by given scores, expanded and ranked", _deep, {"keywords": Bound(str), "scores": Bound(dict), "current_year": Bound(int), "seeds": Bound(int, 5, 1, 100), "top": Bound(int, 50, 1, 1000)}, ("keywords", "current_year"))
_add("dataset.info", "Size of the collection", lambda t: {"records": t.works.count(), "columns": t.works.columns})
_add("ds.citations.co_cite", "References that several works share", lambda t, min_count: citations.co_citation(t, min_count, keep_missing=False), {"min_count": Bound(int, 2, 1, 1000)})
_add("ds.store.seeds.candidates", "Works the collection cites most for their fame", lambda t, top, min_in_domain: citations.seed_candidates(t, top, min_in_domain), {"top": Bound(int, 10, 1, 200), "min_in_domain": Bound(int, 2, 1, 1000)})
_add("citations.network_stats", "How much stays inside", citations.network_stats)
_add("ds.store.rank", "Works by importance", lambda t, current_year, top: store.top_k(store.importance(t.works.select(F.col("work_id").alias("store_id"), "year", F.col("citations").alias("citation_count"), F.lit(None).cast("double").alias("embedding_sim"), F.col("source_name").alias("venue")), current_year), top), {"current_year": Bound(int), "top": Bound(int, 50, 1, 1000)}, ("current_year",))


# Operations on a session's store; the session's id comes from ds.session.new.
SESSIONS = deep.Sessions()
_SESSION = {"session_id": Bound(str)}


def _ids(t: Tables, ids: str):
    return t.works.select(F.col("work_id").cast("string").alias("store_id")).where(F.col("store_id").isin(*[i.strip() for i in ids.split(",")]))


_add("ds.session.new", "A new session with an empty store", lambda t: {"session_id": SESSIONS.new().session_id})
_add("ds.papers.search", "Search and add to the store", lambda t, session_id, keywords, limit, year_upper_limit: deep.search_papers(SESSIONS.get(session_id), t, keywords, limit, year_upper_limit), _SESSION | {"keywords": Bound(str), "limit": Bound(int, 100, 1, 1000), "year_upper_limit": Bound(int)}, ("session_id", "keywords"))
_add("ds.papers.judge", "Write scores (paper id to number from 0 to 1) into the store", lambda t, session_id, scores: deep.judge(SESSIONS.get(session_id), t.works.sparkSession.createDataFrame([(str(i), float(x)) for i, x in scores.items()], "store_id string, score double")), _SESSION | {"scores": Bound(dict)}, ("session_id", "scores"))
_add("ds.citations.fetch_refs", "Add what the store's papers cite", lambda t, session_id, limit, only_seeds: deep.expand(SESSIONS.get(session_id), t, "references", limit, bool(only_seeds)), _SESSION | {"limit": Bound(int, 50, 1, 1000), "only_seeds": Bound(int, 0, 0, 1)}, ("session_id",))
_add("ds.citations.fetch_forward", "Add what cites the store's papers", lambda t, session_id, limit, only_seeds: deep.expand(SESSIONS.get(session_id), t, "citations", limit, bool(only_seeds)), _SESSION | {"limit": Bound(int, 100, 1, 1000), "only_seeds": Bound(int, 0, 0, 1)}, ("session_id",))
_add("ds.store.stats", "Figures of the session's store", lambda t, session_id: deep.stats(SESSIONS.get(session_id)), _SESSION, ("session_id",))
_add("ds.store.expand", "Add references or citing works of the store's papers", lambda t, session_id, direction, limit: deep.expand(SESSIONS.get(session_id), t, direction, limit, only_seeds=False), _SESSION | {"direction": Bound(str, "references", choices=("references", "citations")), "limit": Bound(int, 50, 1, 1000)}, ("session_id",))
_add("ds.store.seeds.mark", "Mark papers (ids joined by commas) as seeds", lambda t, session_id, paper_ids: {"seeds": deep.mark_seeds(SESSIONS.get(session_id), _ids(t, paper_ids))}, _SESSION | {"paper_ids": Bound(str)}, ("session_id", "paper_ids"))
_add("ds.store.session_rank", "The store's papers by importance", lambda t, session_id, current_year, top: deep.rank(SESSIONS.get(session_id), t, current_year, None, top), _SESSION | {"current_year": Bound(int), "top": Bound(int, 50, 1, 1000)}, ("session_id", "current_year"))


def list_tools() -> list[str]:
    return sorted(TOOLS)


def describe(name: str) -> dict:
    return {"name": name, "description": TOOLS[name].description, "schema": TOOLS[name].schema()}


def run_tool(name: str, tables: Tables, arguments: dict | None = None):
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    return TOOLS[name].run(tables, arguments)


def preview(result, rows: int = 3):
    """The first rows of a result, as an agent sees it."""
    if isinstance(result, dict):
        return {k: preview(v, rows) for k, v in result.items()}
    return [r.asDict(recursive=True) for r in result.limit(rows).collect()] if hasattr(result, "limit") else result
