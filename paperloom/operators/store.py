"""The paper store as a table: upsert with history, scores, tags, ranking, statistics. Every change returns a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.scalars import count
from paperloom.session import checkpointed

#: Weights of the store's default ranking, of search strategies, of deep search and of the rank tool.
DEFAULT_WEIGHTS = {"relevance": 0.4, "centrality": 0.3, "recency": 0.3}
STRATEGIES = {"precise": {"relevance": 0.7, "recency": 0.1, "centrality": 0.2}, "balanced": {"relevance": 0.5, "recency": 0.2, "centrality": 0.3}, "impact": {"relevance": 0.3, "recency": 0.1, "centrality": 0.6}}
DEEP_WEIGHTS = {"relevance": 0.6, "centrality": 0.2, "recency": 0.2}
TOOL_WEIGHTS = {"relevance": 0.5, "centrality": 0.25, "recency": 0.25}
HIGH, BOOST = 0.93, 0.3
#: Attributes of an arriving paper that make a store row.
CARRIED = ("title", "year", "venue", "citation_count")


def resolve(arrivals: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The store id of arrivals (``seq, openalex_id, corpus_id, ...``): that of the store's row, or else of the first arrival,
    with the same openalex id; else the corpus id, else the openalex id. Rows without either id go."""
    rows = arrivals.where(F.coalesce(F.nullif("openalex_id", F.lit("")), F.nullif("corpus_id", F.lit(""))).isNotNull())
    own = F.coalesce(F.nullif("corpus_id", F.lit("")), F.nullif("openalex_id", F.lit("")))
    known = rows.where("openalex_id <> ''").select("openalex_id", own.alias("own"), F.col("seq").cast("bigint").alias("seq"))
    if store is not None:
        known = known.unionByName(store.where("openalex_id is not null").select("openalex_id", F.col("store_id").alias("own"), F.lit(-1).cast("bigint").alias("seq")))
    first = known.groupBy("openalex_id").agg(F.min_by("own", F.struct("seq", "own")).alias("_first"))
    return rows.join(first, "openalex_id", "left").withColumn("store_id", F.coalesce("_first", own)).drop("_first")


def upsert(store: DataFrame | None, arrivals: DataFrame) -> DataFrame:
    """Merge arrivals (with ``seq, round, source, keywords, parent_id, search_rank``) into the store.

    The first arrival of an id gives the attributes; later ones add discoveries, parents and a missing openalex id. One
    shuffle by id: the store's rows and the arrivals are united and folded.
    """
    rows = resolve(arrivals, store)
    event = F.struct("seq", "round", "source", "keywords", "parent_id", "search_rank")
    fresh = rows.select("store_id", F.col("seq").alias("seq"), F.nullif("openalex_id", F.lit("")).alias("openalex_id"), *CARRIED, F.array(event).alias("history"))
    if store is not None:
        fresh = store.select("store_id", F.lit(-1).cast("bigint").alias("seq"), "openalex_id", *CARRIED, "history").unionByName(fresh)
    first = F.struct("seq", *CARRIED)
    merged = fresh.groupBy("store_id").agg(F.min(first).alias("a"), F.min(F.when(F.col("openalex_id").isNotNull(), F.struct("seq", "openalex_id")))["openalex_id"].alias("openalex_id"), F.array_sort(F.flatten(F.collect_list("history"))).alias("history"))
    return merged.select("store_id", "openalex_id", *[F.col(f"a.{c}").alias(c) for c in CARRIED], "history")


def history_columns(store: DataFrame) -> DataFrame:
    """What the history says: discoveries, first source and round, keywords that found a paper, parents."""
    h = F.col("history")
    named = lambda field: F.array_sort(F.array_distinct(F.filter(F.transform(h, lambda x: x[field]), lambda k: k.isNotNull())))
    return store.withColumns({"n_discoveries": F.size(h), "first_source": F.get(h, 0)["source"], "first_round": F.get(h, 0)["round"], "source_keywords": named("keywords"), "parent_ids": named("parent_id")})


def find(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by either id: ``ids`` has ``paper_id``; the store id wins over the openalex id."""
    keyed = store.select("*", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("store_id").alias("k")), F.struct(F.lit(1).alias("p"), F.col("openalex_id").alias("k")))).alias("_x")).select("*", "_x.p", F.col("_x.k").alias("paper_id")).drop("_x")
    best = Window.partitionBy("paper_id").orderBy("p", "store_id")
    return ids.select("paper_id").distinct().join(keyed, "paper_id").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "p")


def set_scores(store: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """Write ``score`` by ``store_id`` into a score column; rows without a new score keep theirs."""
    if column not in ("llm_score", "embedding_sim", "importance_score", "keyword_match_score", "venue_score", "in_domain_citation_score"):
        raise ValueError(f"{column} is not a score column")
    old = F.col(column) if column in store.columns else F.lit(None).cast("double")
    return store.join(scores.select("store_id", F.col("score").alias("_new")), "store_id", "left").withColumn(column, F.coalesce("_new", old)).drop("_new")


def add_tags(store: DataFrame, ids: DataFrame, tags: Sequence[str], seed: bool = False) -> DataFrame:
    """Append tags (once each) to given rows, and mark them as seeds where asked."""
    marked = store.join(ids.select("store_id", F.lit(True).alias("_hit")).distinct(), "store_id", "left")
    own = F.coalesce("tags", F.array().cast("array<string>"))
    out = marked.withColumn("tags", F.when(F.col("_hit"), F.array_union(own, F.array(*[F.lit(t) for t in tags]))).otherwise(own))
    if seed:
        out = out.withColumn("is_seed", F.coalesce("_hit", "is_seed", F.lit(False)))
    return out.drop("_hit")


def set_edges(store: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Replace the list ``side`` (``references`` or ``citations``) of given rows by ``edges`` (``store_id, edges``: an array of
    structs with a ``corpus_id``). Null lists and rows that aren't given change nothing."""
    if side not in ("references", "citations"):
        raise ValueError(f"{side} is no edge list")
    old = F.col(side) if side in store.columns else F.lit(None).cast(edges.schema["edges"].dataType)
    new = edges.where("edges is not null").groupBy("store_id").agg(F.first("edges").alias("_new"))
    return store.join(new, "store_id", "left").withColumn(side, F.coalesce("_new", old)).drop("_new")


def edge_ids(store: DataFrame, side: str) -> DataFrame:
    """``store_id, ids``: the corpus ids of a list of edges, without empty ones."""
    ids = F.filter(F.transform(side, lambda e: e["corpus_id"].cast("string")), lambda i: i != "")
    return store.select("store_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))


def by_tags(store: DataFrame, tags: Sequence[str], match_all: bool = False) -> DataFrame:
    wanted = F.array(*[F.lit(t) for t in tags])
    return store.where(F.size(F.array_except(wanted, "tags")) == 0 if match_all else F.arrays_overlap("tags", wanted))


def unevaluated(store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    rows = store.where(~F.coalesce("is_evaluated", F.lit(False)))
    return rows.join(ids.select("store_id").distinct(), "store_id", "left_semi") if ids is not None else rows


def relevance(priority: Sequence[str | float] = ("embedding_sim", 0.02)) -> Column:
    """First source of relevance that a row has; a number ends the list."""
    tried: list[Column] = []
    for item in priority:
        if isinstance(item, (int, float)):
            tried.append(F.lit(float(item)))
            break
        tried.append(1.0 / F.greatest(F.col("search_rank"), F.lit(1)) if item == "search_rank" else F.col(item))
    return F.coalesce(*tried, F.lit(0.02))


def importance(store: DataFrame, current_year: int, weights: dict[str, float] | None = None, priority: Sequence[str | float] = ("embedding_sim", 0.02), multiplicative: bool = False, keyword_scale: float = 0.7, embedding_scale: float = 1.0) -> DataFrame:
    """Weighted sum of relevance, centrality, recency and given scores; very relevant rows weigh more. Terms with null inputs are left out."""
    w = DEFAULT_WEIGHTS if weights is None else weights
    has = lambda c: F.col(c) if c in store.columns else F.lit(None).cast("double")
    emb, kw = relevance(priority), has("keyword_match_score")
    more = lambda c: F.when(c >= HIGH, BOOST).otherwise(0.0)
    keyword = F.coalesce(kw, F.lit(0.0))
    terms: list[Column] = []
    if multiplicative:
        terms.append(w.get("combined_relevance", 0.5) * ((1 + (keyword_scale + more(keyword)) * keyword) * (1 + (embedding_scale + more(emb)) * emb) - 1))
    else:
        if rel := w.get("relevance") or w.get("embedding_sim"):
            terms.append((rel + more(emb)) * emb)
        if "keyword_match_score" in w:
            terms.append(F.coalesce((w["keyword_match_score"] + more(kw)) * kw, F.lit(0.0)))
    central, recent = S.centrality(F.col("citation_count")), S.recency(F.col("year"), current_year)
    if cen := w.get("centrality") or w.get("citation_count"):
        terms.append(cen * central)
    if "recency" in w:
        terms.append(w["recency"] * recent)
    if "venue_score" in w:
        terms.append(w["venue_score"] * F.when(F.coalesce("venue", F.lit("")) != "", 0.5).otherwise(0.0))
    for name in ("llm_score", "in_domain_citation_score"):
        if name in w:
            terms.append(F.coalesce(w[name] * has(name), F.lit(0.0)))
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return store.withColumns({"relevance_score": emb, "centrality_score": central, "recency_score": recent, "importance_score": total})


def blend_in_domain(weights: dict[str, float], share: float = 0.15, renormalise: bool = True) -> dict[str, float]:
    """Make room for the in-domain score: the others get the rest, in proportion (or just times the rest)."""
    total = sum(weights.values()) if renormalise else 1.0
    return {k: v / total * (1 - share) for k, v in weights.items()} | {"in_domain_citation_score": share}


def top_k(store: DataFrame, k: int, score: str = "importance_score", only_unevaluated: bool = False) -> DataFrame:
    rows = unevaluated(store) if only_unevaluated else store
    return rows.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), "store_id").limit(k)


def all_scored(store: DataFrame, score: str = "llm_score") -> DataFrame:
    return store.where(F.col(score).isNotNull()).orderBy(F.desc(score), "store_id")


def ranked(rows: DataFrame, column: str, *order: Column | str) -> DataFrame:
    """``rows`` with their rank from 1 over all of them, without one task that holds them all.

    Rows are sorted by ranges and written to the checkpoint folder, so that each keeps its part and its place there; a rank is
    that place and the rows of the parts before. ``order`` should end with an id.
    """
    at = f"_{column}"
    fixed = checkpointed(rows.orderBy(*order)).withColumn(at, F.monotonically_increasing_id())
    placed = fixed.withColumn(f"{at}_part", F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy(f"{at}_part").agg(count().alias("n"))
    before = F.sum("n").over(Window.orderBy(f"{at}_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(f"{at}_part", F.coalesce(before, F.lit(0)).alias(f"{at}_before"))  # one row for each part
    found = placed.join(F.broadcast(starts), f"{at}_part")
    return found.withColumn(column, F.col(f"{at}_before") + F.col(at) + 1).select(*rows.columns, column)


def tiers(store: DataFrame, llm: float = 0.3, embedding: float = 0.2) -> DataFrame:
    """Three tiers: judged well, else similar, else the rest by its scores; ``tier`` and the ``rank`` over all."""
    tier = F.when(F.col("llm_score") >= llm, 1).when(F.col("embedding_sim") >= embedding, 2).otherwise(3)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    inside = [F.when(tier == 1, F.col("llm_score")).when(tier == 2, F.col("embedding_sim")).otherwise(F.when(F.col("relevance_score").isNotNull(), 1.0).otherwise(0.0)), *[F.when(tier == 3, zero(c)).otherwise(0.0) for c in ("relevance_score", "centrality_score", "recency_score")]]
    rows = store.withColumn("tier", tier)
    return ranked(rows, "rank", "tier", *[F.desc(c) for c in inside], "store_id")


def strategy_sort(papers: DataFrame, current_year: int, strategy: str = "precise", rerank: DataFrame | None = None, seed_relevance: float = 0.5) -> DataFrame:
    """Order by a strategy's weights. Relevance: a reranker's score, else 1/place by search rank, else a third of the seed's.

    A paper without a year has recency 0.5 here (0 in the store).
    """
    w = STRATEGIES.get(strategy, STRATEGIES["precise"])
    found = F.coalesce("search_rank", F.lit(0)) > 0
    rows = ranked(papers, "_at", F.desc(found), "search_rank", "store_id")  # those with a search rank come first
    rows = rows.withColumn("_fallback", F.when(found, 1.0 / F.col("_at"))).drop("_at")
    if rerank is not None:
        top = F.col("_top")
        scaled = rerank.crossJoin(F.broadcast(rerank.agg(F.max("score").alias("_top"))))  # one row
        scaled = scaled.select("store_id", F.when(top > 1, F.col("score") / top).otherwise(F.col("score")).alias("_rerank"))
        rows = rows.join(scaled, "store_id", "left")
    else:
        rows = rows.withColumn("_rerank", F.lit(None).cast("double"))
    rel = F.coalesce("_rerank", "_fallback", F.lit(seed_relevance / 3))
    rec = F.when(F.coalesce("year", F.lit(0)) == 0, 0.5).otherwise(S.recency(F.col("year"), current_year))
    score = w["relevance"] * rel + w["recency"] * rec + w["centrality"] * S.centrality(F.col("citation_count"))
    return rows.withColumn("sort_score", score).drop("_fallback", "_rerank").orderBy(F.desc("sort_score"), "store_id")


def judge_queue(store: DataFrame, k: int) -> DataFrame:
    """Unjudged papers in the order a judge reads them: by search rank, then importance."""
    return unevaluated(store).orderBy(F.coalesce("search_rank", F.lit(9999)), F.coalesce("importance_score", F.lit(0.0)).desc(), "store_id").limit(k)


def seeds_by_score(store: DataFrame, k: int) -> DataFrame:
    """Best judged papers, filled up by importance."""
    return store.orderBy(F.col("llm_score").desc_nulls_last(), F.col("importance_score").desc_nulls_last(), "store_id").limit(k)


def stats(store: DataFrame, current_round: int = 0) -> DataFrame:
    first = F.get(F.col("history"), 0)["source"]
    words = store.select(F.explode(F.transform("history", lambda x: x["keywords"])).alias("k")).where("k is not null").agg(F.count_distinct("k").alias("keywords_used"))
    row = store.agg(count().alias("total_papers"), F.count_if(first == "search").alias("search_papers"), F.count_if(first == "citation").alias("citation_papers"), F.avg("citation_count").alias("avg_citation_count"))
    if "is_evaluated" in store.columns:
        words = words.crossJoin(F.broadcast(store.agg(F.count_if("is_evaluated").alias("evaluated_count"))))
    return row.crossJoin(F.broadcast(words)).withColumn("current_round", F.lit(current_round))  # one row each


def save(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """A saved store; rows of older files without a history get an empty one."""
    rows = spark.read.parquet(path)
    return rows if "history" in rows.columns else rows.withColumn("history", F.array().cast("array<struct<seq: bigint, round: int, source: string, keywords: string, parent_id: string, search_rank: int>>"))
