"""Iterative search over given tables: keywords, judging by supplied scores, citation expansion, co-citation, final ranking.

A session holds the store as a DataFrame; every step returns a new one and is written to the shared checkpoint folder, so
plans don't grow with the rounds.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.model.tables import Tables
from paperloom.operators import citations, store
from paperloom.session import checkpointed

SUCCESS = 0.5


@dataclass
class Session:
    """A store, its round, and when it was last used."""

    session_id: str
    rows: DataFrame | None = None
    round: int = 0
    used: float = field(default_factory=time.monotonic)


class Sessions:
    """Sessions by id; those unused for ``ttl`` seconds go when a new one is made."""

    def __init__(self, ttl: float = 7200.0, clock=time.monotonic) -> None:
        self.ttl, self.clock = ttl, clock
        self.held: dict[str, Session] = {}

    def new(self) -> Session:
        now = self.clock()
        self.held = {k: s for k, s in self.held.items() if now - s.used <= self.ttl}
        made = Session(uuid.uuid4().hex[:8], used=now)
        self.held[made.session_id] = made
        return made

    def get(self, session_id: str) -> Session:
        found = self.held[session_id]
        found.used = self.clock()
        return found


def _arrivals(works: DataFrame, source: str, round_: int, keywords: str | None = None) -> DataFrame:
    """Works (with ``search_rank`` and ``parent_id`` where known) as arrivals of the store."""
    given = lambda c, kind: F.col(c).cast(kind) if c in works.columns else F.lit(None).cast(kind)
    return works.select(
        (F.lit(round_ << 40) + F.coalesce(given("search_rank", "bigint"), F.lit(0)) * 1_000_000 + F.pmod(F.xxhash64("work_id", given("parent_id", "string")), F.lit(1_000_000))).alias("seq"), F.col("work_id").cast("string").alias("openalex_id"), F.lit(None).cast("string").alias("corpus_id"), "title", given("year", "int").alias("year"),
        F.coalesce(given("source_name", "string"), F.lit("")).alias("venue"), given("citations", "int").alias("citation_count"), F.lit(round_).alias("round"), F.lit(source).alias("source"), F.lit(keywords).cast("string").alias("keywords"), given("parent_id", "string").alias("parent_id"), given("search_rank", "int").alias("search_rank"),
    )


def _merge(session: Session, arrivals: DataFrame) -> dict:
    before = session.rows.count() if session.rows is not None else 0
    fresh = {"llm_score": F.lit(None).cast("double"), "is_evaluated": F.lit(False), "is_seed": F.lit(False), "tags": F.array().cast("array<string>")}
    notes = session.rows.select("store_id", *fresh) if session.rows is not None else None
    merged = store.upsert(session.rows.drop(*fresh) if notes is not None else None, arrivals)
    merged = merged.join(notes, "store_id", "left").withColumns({c: F.coalesce(c, new) for c, new in fresh.items()}) if notes is not None else merged.withColumns(fresh)
    session.rows = checkpointed(merged)
    total = session.rows.count()
    return {"added": total - before, "total": total}


def search_papers(session: Session, t: Tables, keywords: str, limit: int = 100, last_year: int | None = None) -> dict:
    """Works whose titles or abstracts hold all keywords, ranked by citations, merged into the store."""
    from pyspark.sql import Window

    rows = t.works.where(F.col("year") <= last_year) if last_year else t.works
    for word in keywords.lower().split():
        rows = rows.where(F.lower("title").contains(word) | F.lower("abstract").contains(word))
    best = rows.orderBy(F.desc("citations"), "work_id").limit(limit)
    ranked = best.withColumn("search_rank", F.row_number().over(Window.orderBy(F.desc("citations"), "work_id")))
    return _merge(session, _arrivals(ranked, "search", session.round, keywords))


def judge(session: Session, scores: DataFrame) -> dict:
    """Write supplied scores (``store_id, score``) and mark their papers as evaluated; a missing score counts as 0."""
    given = scores.select("store_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).groupBy("store_id").agg(F.max("score").alias("score"))
    rows = store.set_scores(session.rows, given, "llm_score").join(given.select("store_id", F.lit(True).alias("_judged")), "store_id", "left")
    session.rows = checkpointed(rows.withColumn("is_evaluated", F.col("is_evaluated") | F.coalesce("_judged", F.lit(False))).drop("_judged"))
    judged = session.rows.where("is_evaluated")
    return {"evaluated": judged.count(), "success": judged.where(F.col("llm_score") >= SUCCESS).count()}


def _own_works(session: Session, t: Tables, only_seeds: bool) -> DataFrame:
    ids = session.rows.where("is_seed") if only_seeds else session.rows
    return t.works.withColumn("store_id", F.col("work_id").cast("string")).join(ids.select("store_id"), "store_id", "left_semi")


def expand(session: Session, t: Tables, direction: str = "references", per_work: int = 50, only_seeds: bool = True) -> dict:
    """References or citing works of the store's papers (of its seeds), merged with their parents."""
    own = _own_works(session, t, only_seeds)
    if direction == "references":
        found = citations.references_of(t, own, per_work).where("title is not null").select(F.col("work_id").cast("string").alias("parent_id"), F.col("ref_id").alias("work_id"), "title", "year", "citations")
    else:
        found = citations.citations_of(t, own, most_per_work=per_work).select(F.col("cited_id").cast("string").alias("parent_id"), "work_id", "title", "year", "citations")
    return _merge(session, _arrivals(found, "citation", session.round))


def mark_seeds(session: Session, ids: DataFrame) -> int:
    session.rows = checkpointed(store.add_tags(session.rows, ids, ["seed"], seed=True))
    return session.rows.where("is_seed").count()


def stats(session: Session) -> DataFrame:
    """The store's figures; a session that has not searched has no store yet."""
    if session.rows is None:
        raise ValueError("the session's store is empty: search first")
    return store.stats(session.rows, session.round)


def rank(session: Session, t: Tables, current_year: int, weights: dict[str, float] | None = None, top: int = 50) -> DataFrame:
    """Importance with the in-domain score, which the others make room for."""
    inside = citations.in_domain(t).select(F.col("work_id").cast("string").alias("store_id"), "in_domain_citation_score")
    rows = session.rows.join(inside, "store_id", "left").withColumns({"embedding_sim": F.lit(None).cast("double"), "search_rank": F.array_min(F.transform("history", lambda h: h["search_rank"]))})
    scored = store.importance(rows, current_year, store.blend_in_domain(weights or store.DEEP_WEIGHTS), ("embedding_sim", "search_rank", 0.02))
    return store.top_k(scored, top)


def deep_search(t: Tables, keyword_rounds: list[str], scores: DataFrame, current_year: int, seeds: int = 5, top: int = 50) -> DataFrame:
    """Search by each round's keywords, judge, expand from the best papers, and rank what was found."""
    session = Session("deep")
    for n, words in enumerate(keyword_rounds):
        session.round = n
        search_papers(session, t, words)
        judge(session, scores)
    best = store.seeds_by_score(session.rows.withColumn("importance_score", F.lit(None).cast("double")), seeds)
    mark_seeds(session, best.select("store_id"))
    session.round += 1
    expand(session, t, "references")
    expand(session, t, "citations")
    judge(session, scores)
    return rank(session, t, current_year, top=top)
