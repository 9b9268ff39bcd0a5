"""Works search as predicates, point lookups, keyword match, and the planner that routes a request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S


@dataclass(frozen=True)
class WorksRequest:
    """Conjunctive constraints; at least one is needed."""

    from_year: int | None = None
    to_year: int | None = None
    min_citations: int | None = None
    max_citations: int | None = None
    types: tuple[str, ...] = ()
    is_oa: bool | None = None
    source_id: str | None = None
    topic_ids: tuple[str, ...] = ()
    country: str | None = None
    author_id: str | None = None
    institution_id: str | None = None
    query: str | None = None
    limit: int = 100
    include: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if all(getattr(self, f) in (None, ()) for f in ("from_year", "to_year", "min_citations", "max_citations", "types", "is_oa", "source_id", "topic_ids", "country", "author_id", "institution_id", "query")):
            raise ValueError("give at least one constraint")
        if self.from_year is not None and self.to_year is not None and self.from_year > self.to_year:
            raise ValueError("from_year is after to_year")
        if self.min_citations is not None and self.max_citations is not None and self.min_citations > self.max_citations:
            raise ValueError("min_citations is over max_citations")
        if not 1 <= self.limit <= 10_000:
            raise ValueError("limit must be from 1 to 10000")


def predicate(r: WorksRequest) -> Column:
    """The constraints on flat work columns; all reach the scan."""
    out = F.lit(True)
    for column, low, high in (("year", r.from_year, r.to_year), ("citations", r.min_citations, r.max_citations)):
        out = out & (F.col(column) >= low) if low is not None else out
        out = out & (F.col(column) <= high) if high is not None else out
    out = out & F.col("type").isin(*r.types) if r.types else out
    out = out & F.col("is_oa").eqNullSafe(r.is_oa) if r.is_oa is not None else out
    out = out & (F.col("source_id") == r.source_id) if r.source_id is not None else out
    for word in (r.query or "").lower().split():
        out = out & (F.lower("title").contains(word) | F.lower("abstract").contains(word))
    return out


def search(t, r: WorksRequest) -> DataFrame:
    """Matching works, best cited first. Constraints on nested lists are semi joins on the flat tables."""
    rows = t.works.where(predicate(r))
    for test, table in ((F.col("topic_id").isin(*r.topic_ids) if r.topic_ids else None, t.topics), (F.col("country_code") == r.country if r.country else None, t.institutions), (F.col("institution_id") == r.institution_id if r.institution_id else None, t.institutions), (F.col("author_id") == r.author_id if r.author_id else None, t.authorships)):
        if test is not None:
            rows = rows.join(table.where(test).select("work_id").distinct(), "work_id", "left_semi")
    return rows.orderBy(F.desc("citations"), "work_id").limit(r.limit)


def selected_fields(include: tuple[str, ...] = ()) -> list[str]:
    """Columns a request needs; the rest never leaves the source."""
    extra = {"authors": ["authors"], "topics": ["topics"], "references": ["referenced_works"], "abstract": ["abstract_inverted_index"]}
    return ["id", "doi", "title", "publication_year", "publication_date", "type", "cited_by_count", "is_oa", "source", *[c for i in include for c in extra.get(i, [])]]


def get_work(works: DataFrame, identifier: str) -> DataFrame:
    wanted = S.work_identifier(F.lit(identifier))
    return works.where((S.compact_id(F.col("id")) == wanted) | (F.lower(F.col("doi")) == F.lower(wanted))).limit(1)


def authors_of(t, work_id: object, position: int | None = None) -> DataFrame:
    """All authors of a work in order, or the one at a position (from 1); none where it is out of range."""
    rows = t.authorships.where(F.col("work_id") == work_id)
    return (rows.where(F.col("apos") == position) if position else rows).orderBy("apos")


def author_candidates(t, name: str, top: int = 10) -> DataFrame:
    rows = t.authorships.where(F.lower("author_name").contains(name.lower())).groupBy("author_id").agg(F.min("author_name").alias("name"), F.count_distinct("work_id").alias("works_count"))
    return rows.orderBy(F.desc("works_count"), "author_id").limit(top)


def resolve_entity(entities: DataFrame, name: str, top: int = 3) -> dict:
    """What a name means among entities (``id, display_name, works_count, cited_by_count``): the best hit, the ``top`` candidates
    and a note where there are several. Equal names lead, then names that begin with it, then those that hold it; larger
    entities first. No hit raises ``ValueError``."""
    own = F.lower(F.trim(F.col("display_name")))
    wanted = name.strip().lower()
    hits = entities.where(own.contains(wanted)).orderBy(F.when(own == wanted, 0).when(own.startswith(wanted), 1).otherwise(2), F.desc_nulls_last("works_count"), "id").limit(top)
    found = [r.asDict() for r in hits.select(S.compact_id(F.col("id")).alias("id"), "display_name", "works_count", "cited_by_count").collect()]
    if not found:
        raise ValueError(f"no entity named {name!r}")
    notes = [f"{name!r} was taken for {found[0]['display_name']!r}; candidates holds the others"] if len(found) > 1 else []
    return {"input": name, "id": found[0]["id"], "display_name": found[0]["display_name"], "candidates": found, "diagnostics": notes}


def keyword_search(docs: DataFrame, query: str, top: int = 100) -> DataFrame:
    """Texts by the share of query words they hold; offline stand-in for a keyword service, with its search rank."""
    from pyspark.sql import Window

    words = sorted(set(query.lower().split()))
    hits = [F.lower("text").contains(w).cast("int") for w in words]
    share = F.aggregate(F.array(*hits), F.lit(0), lambda s, x: s + x) / float(len(words))
    best = docs.select("doc_id", share.alias("keyword_match_score")).where("keyword_match_score > 0").orderBy(F.desc("keyword_match_score"), "doc_id").limit(top)
    return best.withColumn("search_rank", F.row_number().over(Window.orderBy(F.desc("keyword_match_score"), "doc_id")))


def plan(r: WorksRequest, provider: str = "auto") -> dict:
    """Dominant filter, table and count route of a request."""
    ranked = [("author", r.author_id), ("institution", r.institution_id), ("source", r.source_id), ("topic", r.topic_ids), ("country", r.country), ("query", r.query), ("year", r.from_year or r.to_year), ("citations", r.min_citations or r.max_citations), ("type", r.types), ("oa", r.is_oa)]
    given = [name for name, value in ranked if value not in (None, ())]
    tables = {"author": "authorships", "institution": "institutions", "country": "institutions", "topic": "topics"}
    return {"provider": "api" if provider == "auto" and r.query else provider if provider != "auto" else "database", "dominant_filter": given[0], "secondary_filters": given[1:], "fact_table": tables.get(given[0], "works"), "count_from_aggregate": len(given) == 1 and given[0] in ("year", "type", "source")}
