"""Bibliometrics: overview, yearly impact, authors, sources, topics, top papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.scalars import count
from paperloom.model.tables import Tables


def annual_impact(t: Tables) -> DataFrame:
    """Papers and citations by year, running sums, and flags of years whose figures will still grow.

    The windows run over one row for each year, after the aggregation.
    """
    yearly = t.works.where("year is not null").groupBy("year").agg(count().alias("n_papers"), F.sum("citations").alias("total_citations"))
    by_year = Window.orderBy("year")
    running = by_year.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    last = F.max("year").over(everything)
    return yearly.select(
        "year", "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"), F.sum("n_papers").over(running).alias("cumulative_papers"), F.sum("total_citations").over(running).alias("cumulative_citations"),
        ((F.col("year") == last) & F.coalesce(F.col("n_papers") < 0.5 * F.lag("n_papers").over(by_year), F.lit(False))).alias("year_is_incomplete"), (F.col("year") >= last - 1).alias("citation_lag_warning"),
    )


def growth_rate(t: Tables) -> DataFrame:
    """Compound yearly growth of papers in percent; null with fewer than two years."""
    yearly = t.works.where("year is not null").groupBy("year").agg(count().alias("n"))
    ends = yearly.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"))
    years = F.col("last_year") - F.col("first_year")
    return ends.select("first_year", "last_year", F.when(years > 0, (F.pow(F.col("last_n") / F.col("first_n"), 1.0 / years) - 1) * 100).alias("annual_growth_rate"))


def overview(t: Tables) -> DataFrame:
    """One row of totals, percentiles (linear interpolation) and shares."""
    q = F.percentile("citations", [0.25, 0.5, 0.75, 0.9])
    row = t.works.agg(count().alias("total_papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("total_citations"), F.avg("citations").alias("avg_citations"), q.alias("q"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("is_oa").eqNullSafe(True)).alias("open_access_count"))
    share = F.when(F.col("total_papers") > 0, F.col("open_access_count") / F.col("total_papers")).alias("open_access_share")
    return row.select("total_papers", "total_citations", "avg_citations", F.col("q")[1].alias("median_citations"), *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90"))], "first_year", "last_year", "open_access_count", share)


def document_types(t: Tables) -> DataFrame:
    return t.works.groupBy("type").agg(count().alias("n_papers"))


def _ranked(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(top)


def top_authors(t: Tables, top: int = 20) -> DataFrame:
    """Distinct papers; citations once for each time an author is listed; h-index over the listings."""
    listed = t.authorships.join(t.works.select("work_id", "citations"), "work_id")
    rows = listed.groupBy("author_id").agg(F.min("author_name").alias("name"), F.count_distinct("work_id").alias("n_papers"), F.sum("citations").alias("total_citations"), S.h_index(F.collect_list("citations")).alias("h_index"))
    rows = rows.select(F.col("author_id").alias("id"), "name", "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"), "h_index")
    return _ranked(rows, top, F.desc("n_papers"), F.desc("total_citations"), F.asc("id"))


def top_sources(t: Tables, top: int = 20) -> DataFrame:
    rows = t.works.where("source_name <> ''").groupBy(F.col("source_id").alias("id")).agg(F.min("source_name").alias("name"), F.min("source_type").alias("type"), count().alias("n_papers"), F.sum("citations").alias("total_citations"), S.h_index(F.collect_list("citations")).alias("h_index"))
    rows = rows.select("id", "name", "type", "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"), "h_index")
    return _ranked(rows, top, F.desc("n_papers"), F.desc("total_citations"), F.asc("id"))


def top_topics(t: Tables, top: int = 30, min_count: int = 1) -> DataFrame:
    """Topic mentions, their share of all papers in percent, mean score, citations."""
    total = t.works.agg(count().alias("total"))
    listed = t.topics.join(t.works.select("work_id", "citations"), "work_id")
    rows = listed.groupBy(F.col("topic_id").alias("id")).agg(F.min("topic").alias("name"), count().alias("frequency"), F.avg("score").alias("avg_score"), F.sum("citations").alias("total_citations")).where(F.col("frequency") >= min_count)
    rows = rows.crossJoin(F.broadcast(total))  # one row
    rows = rows.select("id", "name", "frequency", (F.col("frequency") / F.col("total") * 100).alias("percentage"), "avg_score", "total_citations", (F.col("total_citations") / F.col("frequency")).alias("avg_citations"))
    return _ranked(rows, top, F.desc("frequency"), F.desc("total_citations"), F.asc("id"))


def top_papers(t: Tables, top: int = 20) -> DataFrame:
    """Most cited papers with up to five authors named."""
    first = t.works.orderBy(F.desc("citations"), "pos").limit(top)
    names = t.authorships.join(F.broadcast(first.select("work_id")), "work_id").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("apos", "author_name"))).alias("a"))  # top rows only
    shown = F.array_join(F.transform(F.slice("a", 1, 5), lambda x: x["author_name"]), "; ")
    rows = first.join(names, "work_id", "left")
    rank = F.row_number().over(Window.orderBy(F.desc("citations"), "pos"))
    authors = F.coalesce(F.when(F.size("a") > 5, F.concat(shown, F.lit("; et al."))).otherwise(shown), F.lit(""))
    return rows.select(rank.alias("rank"), F.col("work_id").alias("id"), "title", authors.alias("authors"), "year", F.col("source_name").alias("source"), F.col("citations").alias("cited_by_count"))


def annual_diagnostics(annual: DataFrame) -> list[str]:
    """What a reader should know about the last years."""
    flags = annual.agg(F.bool_or("year_is_incomplete").alias("i"), F.bool_or("citation_lag_warning").alias("c")).first()
    said = []
    if flags["i"]:
        said.append("The latest year looks incomplete; read its counts with care.")
    if flags["c"]:
        said.append("Citations of the latest two years are still accruing.")
    return said
