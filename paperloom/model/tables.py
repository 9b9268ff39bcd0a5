"""The normalised tables that every analysis reads, built from nested works or given directly.

Building explodes each nested array once; analyses then join and aggregate flat rows. A table is only computed where a query
uses it, and Spark prunes the columns it doesn't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.model import schema


def _name(works: DataFrame, column: str, x: Column) -> Column:
    """The name of a topic, whichever of its two fields the records have."""
    there = works.schema[column].dataType.elementType.fieldNames()
    return S.first_truthy(*[x[c] for c in ("name", "display_name") if c in there])


@dataclass(frozen=True)
class Tables:
    """Flat tables keyed by ``work_id``; ``pos`` columns carry the order that breaks ties.

    * works: work_id, pos, title, abstract, year, citations, type, is_oa, doi, source_id, source_name, source_type
    * authorships: work_id, apos (from 1), author_id, author_name, is_first, is_last, is_corresponding
    * institutions: work_id, apos, ipos, institution_id, institution, country_code, institution_type
    * topics: work_id, tpos, topic_id, topic, score
    * refs: work_id, ref_id
    """

    works: DataFrame
    authorships: DataFrame
    institutions: DataFrame
    topics: DataFrame
    refs: DataFrame

    @staticmethod
    def from_works(works: DataFrame, year_field: str = "publication_year") -> "Tables":
        """From nested works (``schema.WORK``); ``pos`` is the row's order in the scan.

        Works without ``authors`` may have an API's raw ``authorships``, and those without ``topics`` ``concepts`` instead.
        """
        if "authorships" in works.columns:
            raw = S.positioned_authors(F.col("authorships")).cast(schema.AUTHORSHIPS)
            works = works.withColumn("authors", F.coalesce(F.col("authors").cast(schema.AUTHORSHIPS), raw) if "authors" in works.columns else raw)
        if "concepts" in works.columns:
            named = lambda c: F.transform(c, lambda x: F.struct(x["id"].alias("id"), _name(works, "concepts", x).alias("name"), x["score"].cast("double").alias("score")))
            concepts = named(F.col("concepts"))
            works = works.withColumn("topics", F.when(F.size("topics") > 0, F.col("topics").cast(schema.TOPICS)).otherwise(concepts) if "topics" in works.columns else concepts)
        base = works.withColumn("_pos", F.monotonically_increasing_id())
        year = S.int_or_null(F.coalesce(F.col(year_field), F.col("publication_year")).cast("string"))
        work_id = S.compact_id(F.col("id"))
        abstract = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), S.inverted_index_text(F.col("abstract_inverted_index")), F.lit("")) if "abstract_inverted_index" in works.columns else F.coalesce("abstract", F.lit(""))
        flat = base.select(
            work_id.alias("work_id"), F.col("_pos").alias("pos"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), abstract.alias("abstract"), year.alias("year"), S.int_or_zero(F.col("cited_by_count")).alias("citations"),
            F.coalesce("type", F.lit("")).alias("type"), F.col("is_oa"), "doi", S.compact_id(F.col("source.id")).alias("source_id"), F.coalesce("source.name", F.lit("")).alias("source_name"), F.coalesce("source.type", F.lit("")).alias("source_type"),
        )
        authors = base.select(work_id.alias("work_id"), F.size(F.coalesce("authors", F.array())).alias("n_authors"), F.posexplode("authors").alias("p", "a"))
        apos = F.coalesce("a.position", F.col("p") + 1)
        authorships = authors.select(
            "work_id", apos.alias("apos"), F.coalesce(F.nullif(S.compact_id(F.col("a.id")), F.lit("")), F.col("a.display_name"), F.lit("")).alias("author_id"), F.coalesce("a.display_name", F.lit("")).alias("author_name"),
            (F.col("a.author_position").eqNullSafe("first") | (F.col("p") == 0)).alias("is_first"), (F.col("a.author_position").eqNullSafe("last") | (F.col("p") + 1 == F.col("n_authors"))).alias("is_last"), F.col("a.is_corresponding").eqNullSafe(True).alias("is_corresponding"),
        )
        inner = authors.select("work_id", apos.alias("apos"), F.posexplode("a.institutions").alias("ipos", "i"))
        institutions = inner.select(
            "work_id", "apos", "ipos", F.coalesce(F.nullif(S.compact_id(F.col("i.id")), F.lit("")), F.nullif(F.col("i.display_name"), F.lit(""))).alias("institution_id"), F.coalesce("i.display_name", F.lit("")).alias("institution"),
            F.coalesce("i.country_code", F.lit("")).alias("country_code"), F.coalesce("i.type", F.lit("")).alias("institution_type"),
        )
        topics = base.select(work_id.alias("work_id"), F.posexplode("topics").alias("tpos", "t")).select("work_id", "tpos", S.compact_id(F.col("t.id")).alias("topic_id"), F.col("t.name").alias("topic"), F.col("t.score").alias("score"))
        refs = base.select(work_id.alias("work_id"), F.explode("referenced_works").alias("r")).where("r is not null").select("work_id", S.compact_id(F.col("r")).alias("ref_id"))
        return Tables(flat, authorships, institutions, topics, refs)
