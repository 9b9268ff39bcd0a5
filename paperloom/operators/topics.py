"""Topic landscape over given topics, yearly evolution, and hierarchical topic lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions.scalars import count
from paperloom.model.tables import Tables
from paperloom.operators.bibliometrics import top_topics


def topic_landscape(t: Tables, top: int = 30, min_count: int = 2) -> DataFrame:
    return top_topics(t, top, min_count)


def topic_by_year(t: Tables, top: int = 30, min_count: int = 2, selected: list[str] | None = None) -> DataFrame:
    """Yearly mentions of the top topics (and of selected ones)."""
    wanted = top_topics(t, top, min_count).select(F.col("id").alias("topic_id"))
    if selected:
        wanted = wanted.unionByName(t.topics.where(F.col("topic").isin(selected) | F.col("topic_id").isin(selected)).select("topic_id")).distinct()
    listed = t.topics.join(wanted, "topic_id", "left_semi").join(t.works.select("work_id", "year"), "work_id").where("year is not null")
    return listed.groupBy("year", "topic_id").agg(F.min("topic").alias("topic"), count().alias("count"))


def resolve_topic(dimension: DataFrame, query: str) -> DataFrame:
    """The hierarchy level and id that a name stands for: domain, then field, then subfield, else the best topic.

    ``dimension``: rank, topic_id, topic, subfield_id, subfield, field_id, field, domain_id, domain.
    """
    q = F.lit(query)
    tried = []
    for level, name in enumerate(("domain", "field", "subfield")):
        tried.append(dimension.where(S.hierarchical_match(q, F.col(name))).select(F.lit(level).alias("level"), "rank", F.lit(name).alias("kind"), F.col(f"{name}_id").alias("id"), F.col(name).alias("name")))
    tried.append(dimension.select(F.lit(3).alias("level"), "rank", F.lit("topic").alias("kind"), F.col("topic_id").alias("id"), F.col("topic").alias("name")))
    rows = tried[0]
    for more in tried[1:]:
        rows = rows.unionByName(more)
    return rows.orderBy("level", "rank", "id").limit(1).select("kind", "id", "name", S.topic_filter(F.col("id")).alias("filter"))
