"""Author landscape: roles, distinct partners, affiliations, topics, years."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import text as T
from paperloom.functions.scalars import count
from paperloom.model.tables import Tables


def roles(t: Tables) -> DataFrame:
    """Listings as first, last and corresponding author; the only author of a work is all that first and last say."""
    return t.authorships.groupBy("author_id").agg(
        F.count_distinct("work_id").alias("n_papers"), F.count_if("is_first").alias("first_author_papers"), F.count_if("is_last").alias("last_author_papers"), F.count_if("is_corresponding").alias("corresponding_author_papers")
    )


def _author_sets(t: Tables) -> DataFrame:
    return t.authorships.groupBy("work_id").agg(F.array_sort(F.collect_set("author_id")).alias("authors"))


def coauthor_edges(t: Tables, top: int = 300, min_weight: int = 1) -> DataFrame:
    made = _author_sets(t).select(F.explode(T.pairs(F.col("authors"))).alias("p")).select("p.source", "p.target")
    return made.groupBy("source", "target").agg(count().alias("weight")).where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "source", "target").limit(top)


def collaborators(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """Distinct partners of each author (of those in ``of`` alone): pairs inside each work, combined before they are shuffled."""
    made = _author_sets(t).select(F.explode("authors").alias("author_id"), "authors")
    made = made.join(of, "author_id", "left_semi") if of is not None else made
    partner = made.select("author_id", F.explode("authors").alias("partner")).where("author_id <> partner").distinct()
    return partner.groupBy("author_id").agg(count().alias("collaborator_count"))


def _homes(t: Tables) -> DataFrame:
    return t.authorships.select("work_id", "apos", "author_id").join(t.institutions, ["work_id", "apos"]).where("institution_id is not null")


def primary_affiliation(t: Tables) -> DataFrame:
    """Most frequent institution of each author; the first seen on ties."""
    homes = _homes(t).join(t.works.select("work_id", "pos"), "work_id")
    counted = homes.groupBy("author_id", "institution_id").agg(count().alias("n"), F.min(F.struct("pos", "apos", "ipos", "institution", "country_code")).alias("first"))
    best = counted.groupBy("author_id").agg(F.min_by(F.struct("institution_id", "first", "n"), F.struct((-F.col("n")).alias("a"), F.col("first.pos"), F.col("first.apos"), F.col("first.ipos"))).alias("b"))
    return best.select("author_id", F.col("b.first.institution").alias("primary_institution"), F.col("b.first.country_code").alias("primary_country"), F.col("b.n").alias("n_listings"))


def affiliation_counts(t: Tables) -> DataFrame:
    return _homes(t).groupBy("author_id").agg(F.count_distinct("institution_id").alias("institution_count"), F.count_distinct(F.nullif("country_code", F.lit(""))).alias("country_count"))


def author_topics(t: Tables, top: int = 300) -> DataFrame:
    """Each author of a work with each topic of that work."""
    listed = t.authorships.select("work_id", "author_id").distinct().join(t.topics.select("work_id", "topic_id", "topic"), "work_id")
    return listed.groupBy("author_id", "topic_id").agg(count().alias("n")).orderBy(F.desc("n"), "author_id", "topic_id").limit(top)


def by_year(t: Tables) -> DataFrame:
    listed = t.authorships.select("work_id", "author_id").distinct().join(t.works.select("work_id", "year", "citations"), "work_id").where("year is not null")
    return listed.groupBy("author_id", "year").agg(count().alias("n_papers"), F.sum("citations").alias("total_citations"))


def landscape(t: Tables, top: int = 30, min_papers: int = 1) -> DataFrame:
    """The full author table. One pass finds the returned authors; partners, affiliations and topics are made for these alone."""
    flags = {"first_author_papers": "is_first", "last_author_papers": "is_last", "corresponding_author_papers": "is_corresponding"}
    per_paper = t.authorships.groupBy("author_id", "work_id").agg(F.max("author_name").alias("name"), *[F.count_if(f).alias(c) for c, f in flags.items()])
    stats = per_paper.join(t.works.select("work_id", "citations"), "work_id").groupBy("author_id").agg(
        count().alias("n_papers"), *[F.sum(c).alias(c) for c in flags], F.max("name").alias("name"), F.sum("citations").alias("total_citations"), S.h_index(F.collect_list("citations")).alias("corpus_h_index")
    )
    best = stats.where(F.col("n_papers") >= min_papers).orderBy(F.desc("n_papers"), F.desc("total_citations"), "author_id").limit(top)
    ids = F.broadcast(best.select("author_id"))  # at most ``top`` rows
    own = replace(t, authorships=t.authorships.join(ids, "author_id", "left_semi"))
    topics = own.authorships.select("work_id", "author_id").join(t.topics, "work_id").groupBy("author_id").agg(F.count_distinct("topic_id").alias("topic_count"))
    out = best
    for part in (collaborators(t, ids), affiliation_counts(own), topics, primary_affiliation(own).drop("n_listings")):
        out = out.join(part, "author_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        F.col("author_id").alias("id"), "name", "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"), "corpus_h_index", "first_author_papers", "last_author_papers", "corresponding_author_papers",
        zero("collaborator_count"), zero("institution_count"), zero("country_count"), zero("topic_count"), F.coalesce("primary_institution", F.lit("")).alias("primary_institution"), F.coalesce("primary_country", F.lit("")).alias("primary_country"),
    )


def rank_in(rows: DataFrame, by: str, key: str) -> DataFrame:
    """1-based rank inside each ``by`` group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), key)))
