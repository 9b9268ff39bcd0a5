"""Citation overview, reference counts, co-citation, in-domain scores and seed candidates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.scalars import count
from paperloom.model.tables import Tables


def overview(t: Tables) -> DataFrame:
    citing = t.refs.select("work_id").distinct().agg(count().alias("records_with_references"))
    row = t.works.agg(count().alias("total_papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("total_citations"), F.avg("citations").alias("avg_citations"), F.coalesce(F.max("citations"), F.lit(0)).alias("max_citations"), F.count_if(F.col("citations") == 0).alias("zero_citation_count"))
    row = row.crossJoin(F.broadcast(citing))  # one row each
    return row.select("*", F.when(F.col("total_papers") > 0, F.col("zero_citation_count") / F.col("total_papers")).alias("zero_citation_share"))


def citations_by_year(t: Tables) -> DataFrame:
    return t.works.where("year is not null").groupBy("year").agg(count().alias("n_papers"), F.sum("citations").alias("total_citations"), F.max("citations").alias("max_citations"))


def reference_frequency(t: Tables, top: int = 100) -> DataFrame:
    rows = t.refs.groupBy("ref_id").agg(count().alias("frequency")).orderBy(F.desc("frequency"), "ref_id").limit(top)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("frequency"), "ref_id")).alias("rank"), F.col("ref_id").alias("referenced_work"), "frequency")


def in_domain(t: Tables) -> DataFrame:
    """Citations of each work from inside the collection, and the score n * (n / total)^2."""
    cited = t.refs.select("work_id", "ref_id").distinct().groupBy("ref_id").agg(count().alias("n"))
    rows = t.works.select("work_id", "title", "year", "citations").join(cited, F.col("work_id") == F.col("ref_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("work_id", "title", "year", "citations", n.alias("in_domain_citations"), S.in_domain_score(n, F.col("citations")).alias("in_domain_citation_score"))


def network_stats(t: Tables) -> DataFrame:
    """How much of all references stays inside the collection."""
    inside = t.refs.join(t.works.select(F.col("work_id").alias("ref_id")), "ref_id", "left_semi").agg(count().alias("in_domain_references"))
    cited = in_domain(t).agg(count().alias("total_papers"), F.count_if(F.col("in_domain_citations") > 0).alias("papers_with_in_domain_citations"), F.sum("in_domain_citations").alias("total_in_domain_citations"))
    total = t.refs.agg(count().alias("total_references"))
    row = cited.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(inside))  # one row each
    return row.select("*", F.when(F.col("total_references") > 0, F.col("in_domain_references") / F.col("total_references")).alias("in_domain_ratio"))


def co_citation(t: Tables, min_count: int = 2, top: int | None = None, keep_missing: bool = True) -> DataFrame:
    """References that several works share; ``in_store`` says whether they are works themselves."""
    rows = t.refs.select("work_id", "ref_id").distinct().groupBy("ref_id").agg(count().alias("co_citation_count"), F.min("work_id").alias("first_citing"), F.max("work_id").alias("last_citing")).where(F.col("co_citation_count") >= min_count)
    known = t.works.select(F.col("work_id").alias("ref_id"), F.col("title").alias("known_title"))
    rows = rows.join(known, "ref_id", "left" if keep_missing else "inner").select("ref_id", "co_citation_count", "first_citing", "last_citing", F.col("known_title").isNotNull().alias("in_store"))
    return rows.orderBy(F.desc("co_citation_count"), "ref_id").limit(top) if top else rows


def collection(t: Tables, wanted: Column) -> Tables:
    """The tables with the references of the works that a condition on works holds for."""
    return replace(t, refs=t.refs.join(t.works.where(wanted).select("work_id"), "work_id", "left_semi"))


def missing_band(rows: DataFrame, known: DataFrame) -> DataFrame:
    """References outside the collection worth fetching: counts from a threshold set by the backlog up to six more (at most 16)."""
    missing = rows.join(known.select(F.col("work_id").alias("ref_id")), "ref_id", "left_anti")
    backlog = missing.agg(count().alias("backlog"))
    b = F.col("backlog")
    least = F.when(b < 680, 3).when(b < 2500, 4).when(b < 6800, 5).when(b < 14000, 7).otherwise(10)
    return missing.crossJoin(F.broadcast(backlog)).where((F.col("co_citation_count") >= least) & (F.col("co_citation_count") <= F.least(least + 6, F.lit(16)))).drop("backlog")


def seed_candidates(t: Tables, top: int = 10, min_in_domain: int = 2, min_total: int = 1, seeds: DataFrame | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Works that the collection cites most for their fame; rows without a year drop where years are asked for."""
    rows = in_domain(t).where((F.col("in_domain_citations") >= min_in_domain) & (F.col("citations") >= min_total))
    if seeds is not None:
        rows = rows.join(seeds.select("work_id").distinct(), "work_id", "left_anti")
    if years:
        rows = rows.where(F.col("year").between(*years))
    rows = rows.withColumn("ratio", F.when(F.col("citations") > 0, F.col("in_domain_citations") / F.col("citations")))
    return rows.orderBy(F.desc("in_domain_citation_score"), F.desc("in_domain_citations"), "work_id").limit(top)


def references_of(t: Tables, works: DataFrame, limit_per_work: int = 50) -> DataFrame:
    """Referenced works of given works, at most so many each, with what is known about them."""
    asked = t.refs.join(works.select("work_id").distinct(), "work_id", "left_semi").distinct()
    ranked = asked.withColumn("n", F.row_number().over(Window.partitionBy("work_id").orderBy("ref_id"))).where(F.col("n") <= limit_per_work)
    return ranked.join(t.works.select(F.col("work_id").alias("ref_id"), "title", "year", "citations"), "ref_id", "left").select("work_id", "ref_id", "title", "year", "citations")


def citations_of(t: Tables, works: DataFrame, years: tuple[int, int] | None = None, min_citations: int = 0, most_per_work: int = 100) -> DataFrame:
    """Works that cite given works: filtered, best cited first, at most so many for each."""
    citing = t.refs.distinct().join(works.select(F.col("work_id").alias("ref_id")).distinct(), "ref_id", "left_semi").join(t.works.select("work_id", "title", "year", "citations"), "work_id").where(F.col("citations") >= min_citations)
    if years:
        citing = citing.where(F.col("year").between(*years))
    order = Window.partitionBy("ref_id").orderBy(F.desc("citations"), "work_id")
    return citing.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_per_work).select(F.col("ref_id").alias("cited_id"), "work_id", "title", "year", "citations")


def filter_papers(papers: DataFrame, year_start: int | None = None, year_end: int | None = None, min_citations: int = 0, keep_null_year: bool = True) -> DataFrame:
    """Lookup results by year and citations; whether rows without a year stay is the caller's rule."""
    year = F.col("year")
    null_ok = year.isNull() if keep_null_year else F.lit(False)
    if year_start is not None:
        papers = papers.where(null_ok | (year >= year_start))
    if year_end is not None:
        papers = papers.where(null_ok | (year <= year_end))
    return papers.where(F.coalesce("citation_count", F.lit(0)) >= min_citations) if min_citations else papers
