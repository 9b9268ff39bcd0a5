"""Co-word analysis: terms, edges, degrees, evolution, provenance, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.scalars import count


def documents_terms(docs: DataFrame, text: Column, ngram: tuple[int, int] = (1, 2), pattern: str = T.TOKEN_PATTERN, stopwords: tuple[str, ...] = T.ENGLISH_STOPWORDS, aliases: DataFrame | None = None) -> DataFrame:
    """One row for each occurrence of a term: ``doc_id``, ``term``. ``aliases`` (term, canonical) rename terms before they count.

    Tokens of the patterns and their n-grams already have the form that ``clean_term`` gives, so it isn't run on each.
    """
    rows = docs.select("doc_id", F.explode(T.ngrams(T.tokens(text, pattern, stopwords), *ngram)).alias("term"))
    if aliases is not None:
        known = aliases.select(T.clean_term(F.col("term")).alias("term"), T.clean_term(F.col("canonical")).alias("canonical"))
        rows = rows.join(known, "term", "left").select("doc_id", F.coalesce("canonical", "term").alias("term"))
    return rows


def term_counts(terms: DataFrame) -> DataFrame:
    """Occurrences and documents of each term that carries meaning."""
    per_doc = terms.groupBy("term", "doc_id").agg(count().alias("n"))
    counted = per_doc.groupBy("term").agg(F.sum("n").alias("count"), count().alias("doc_count"))
    # Inside a test that is random by name (and always true), the costly rule stays above the aggregation: it runs once for
    # each distinct term. Spark would move a plain filter on the grouping key below, to every occurrence.
    return counted.where(F.when(F.rand(0) >= 0, ~T.is_low_signal(F.col("term"))).otherwise(F.lit(False)))


def dropped_terms(terms: DataFrame, top: int = 50) -> DataFrame:
    return terms.where(T.is_low_signal(F.col("term"))).groupBy("term").agg(count().alias("count")).orderBy(F.desc("count"), "term").limit(top)


def allowed_terms(counts: DataFrame, min_count: int = 2) -> DataFrame:
    return counts.where((F.col("count") >= min_count) & (F.length("term") > 1))


def _weights(terms: DataFrame, allowed: DataFrame) -> DataFrame:
    kept = terms.join(allowed.select("term"), "term", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    made = kept.select(F.explode(T.pairs(F.col("terms"))).alias("p")).select("p.source", "p.target")
    return made.groupBy("source", "target").agg(count().alias("weight"))


def edges(terms: DataFrame, allowed: DataFrame, top: int = 300, min_weight: int = 1, first: int = 200) -> DataFrame:
    """The ``top`` heaviest pairs of ``allowed`` terms (term, doc_count) that share documents.

    Pairing is quadratic in a document's terms, so it is done for terms that can matter: a pair weighs no more than either
    term has documents. The pairs of the ``first`` commonest terms give a weight that ``top`` pairs reach; every term with as
    many documents is then paired, and no pair of any other term could be among the ``top``.
    """
    best = lambda pairs: pairs.where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "source", "target").limit(top)
    common = best(_weights(terms, allowed.orderBy(F.desc("doc_count"), "term").limit(first)))
    reached = common.agg(F.when(count() == top, F.min("weight")).otherwise(F.lit(min_weight)).alias("reached"))  # one row
    able = allowed.crossJoin(F.broadcast(reached)).where("doc_count >= reached")
    return best(_weights(terms, able))


def degrees(kept_edges: DataFrame) -> DataFrame:
    """Degree and weighted degree over the kept edges."""
    ends = kept_edges.select(F.explode(F.array("source", "target")).alias("term"), "weight")
    return ends.groupBy("term").agg(count().alias("degree"), F.sum("weight").alias("weighted_degree"))


def term_table(counts: DataFrame, kept_edges: DataFrame, top: int = 100) -> DataFrame:
    best = counts.orderBy(F.desc("count"), F.desc("doc_count"), "term").limit(top)
    rows = best.join(degrees(kept_edges), "term", "left")
    rank = F.row_number().over(Window.orderBy(F.desc("count"), F.desc("doc_count"), "term"))
    return rows.select(rank.alias("rank"), "term", "count", "doc_count", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0)).alias("weighted_degree"))


def term_by_year(terms: DataFrame, years: DataFrame, wanted: DataFrame) -> DataFrame:
    """Yearly occurrences of wanted terms. ``years``: doc_id, year."""
    rows = terms.join(wanted.select("term"), "term", "left_semi").join(years, "doc_id").where("year is not null")
    return rows.groupBy("year", "term").agg(count().alias("count"))


def clusters(members: DataFrame, counts: DataFrame, kept_edges: DataFrame, top_terms: int = 10) -> DataFrame:
    """Aggregates of term clusters. ``members``: term, cluster."""
    rows = members.join(counts, "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "term")), asc=False)
    base = rows.groupBy("cluster").agg(count().alias("term_count"), F.sum("count").alias("occurrence_frequency"), F.sum("doc_count").alias("doc_frequency"), F.transform(F.slice(order, 1, top_terms), lambda x: x["term"]).alias("top_terms"))
    side = lambda end, name: members.select(F.col("term").alias(end), F.col("cluster").alias(name))
    ends = kept_edges.join(side("source", "a"), "source").join(side("target", "b"), "target")
    links = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("cluster"), "weight", (F.col("a") == F.col("b")).alias("inside"))
    strength = links.groupBy("cluster").agg(F.sum("weight").alias("total_link_strength"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("internal_link_strength"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = base.join(strength, "cluster", "left")
    return out.select("cluster", F.array_join(F.slice("top_terms", 1, 3), " / ").alias("label"), "term_count", "top_terms", "occurrence_frequency", "doc_frequency", zero("total_link_strength").alias("total_link_strength"), zero("internal_link_strength").alias("internal_link_strength"), (zero("total_link_strength") - zero("internal_link_strength")).alias("external_link_strength"))
