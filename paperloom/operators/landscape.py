"""The composed workflow: run what is ready, keep failures apart, summarise the top of each table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from paperloom.model.tables import Tables
from paperloom.operators import authors, bibliometrics, citations, macro, readiness, topics

COMPONENTS: dict[str, Callable[[Tables, int, int], dict[str, DataFrame]]] = {
    "bibliometrics": lambda t, top, least: {"overview": bibliometrics.overview(t), "annual": bibliometrics.annual_impact(t), "authors": bibliometrics.top_authors(t, top), "papers": bibliometrics.top_papers(t, top), "sources": bibliometrics.top_sources(t, top), "topics": bibliometrics.top_topics(t, top)},
    "macro": lambda t, top, least: {"overview": macro.overview(t), "countries": macro.countries(t, "full", top, least), "institutions": macro.institutions(t, "full", top, least), "country_edges": macro.edges(t, "country_code"), "density": macro.density(t), "corresponding": macro.corresponding(t, top)},
    "author_landscape": lambda t, top, least: {"authors": authors.landscape(t, top), "edges": authors.coauthor_edges(t), "topics": authors.author_topics(t)},
    "topic_landscape": lambda t, top, least: {"topics": topics.topic_landscape(t, top, least), "by_year": topics.topic_by_year(t, top, least)},
    "citation_overview": lambda t, top, least: {"overview": citations.overview(t), "references": citations.reference_frequency(t), "by_year": citations.citations_by_year(t)},
}


def science_landscape(t: Tables, include: tuple[str, ...] = tuple(COMPONENTS), top: int = 10, min_count: int = 1, skip_unready: bool = True) -> dict:
    """Tables of each component, statuses, and what failed. Plans are lazy: tables run when they are read."""
    status = {x["tool"].removeprefix("analysis."): x for x in readiness.tool_status(t)}
    out: dict = {"results": {}, "skipped": {}, "failed": {}}
    for name in include:
        if skip_unready and status[name]["status"] == "missing":
            out["skipped"][name] = status[name]["message"]
            continue
        try:
            out["results"][name] = COMPONENTS[name](t, top, min_count)
        except Exception as error:  # noqa: BLE001 - one component's failure must not end the others
            out["failed"][name] = str(error)
    return out


def summarize(results: dict[str, dict[str, DataFrame]], rows: int = 10) -> dict[str, dict[str, list[dict]]]:
    """The first rows of each table as plain values."""
    return {name: {table: [r.asDict(recursive=True) for r in df.limit(rows).collect()] for table, df in tables.items()} for name, tables in results.items()}
