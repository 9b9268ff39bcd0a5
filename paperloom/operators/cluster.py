"""Topic models: LDA over term counts, k-means over hash vectors, labels and representative documents."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import udfs as U
from paperloom.functions.scalars import count


def default_topics(n: int) -> int:
    return min(10, max(2, n // 10 or 2))


def long_enough(docs: DataFrame, least: int = 3) -> DataFrame:
    """Texts of at least so many words."""
    return docs.where(F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")) >= least)


def lda(docs: DataFrame, k: int | None = None, words: int = 12, max_features: int = 2000, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """Topics (``topic_id, label, doc_count``, ``words`` with weights) and documents (``doc_id, topic_id, probability``)."""
    rows = long_enough(docs).select("doc_id", T.ngrams(T.tokens(F.col("text")), 1, 2).alias("terms"))
    k = k or default_topics(rows.count())
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=max_features).fit(rows)
    counted = vocabulary.transform(rows)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(counted)
    shares = model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("p"))
    best = F.array_max("p")
    documents = shares.select("doc_id", (F.array_position("p", best) - 1).cast("int").alias("topic_id"), best.alias("probability"))
    names = F.array(*[F.lit(w) for w in vocabulary.vocabulary])
    described = model.describeTopics(words).select(F.col("topic").alias("topic_id"), F.arrays_zip(F.transform("termIndices", lambda i: F.get(names, i)).alias("term"), F.col("termWeights").alias("weight")).alias("words"))
    topics = described.join(documents.groupBy("topic_id").agg(count().alias("doc_count")), "topic_id", "left")
    label = F.array_join(F.transform(F.slice("words", 1, 4), lambda w: w["term"]), ", ")
    return topics.select("topic_id", label.alias("label"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "words"), documents


def kmeans(docs: DataFrame, k: int | None = None, dimensions: int = 64, seed: int = 42, iterations: int = 20) -> DataFrame:
    """``doc_id, topic_id, probability`` (null) of clusters of hash vectors."""
    rows = long_enough(docs).select("doc_id", array_to_vector(U.hash_vector_udf(F.col("text"), dimensions)).alias("features"))
    model = KMeans(k=k or default_topics(rows.count()), seed=seed, maxIter=iterations).fit(rows)
    return model.transform(rows).select("doc_id", F.col("prediction").alias("topic_id"), F.lit(None).cast("double").alias("probability"))


def cluster_labels(docs: DataFrame, assigned: DataFrame, words: int = 12) -> DataFrame:
    """Most frequent terms of each cluster, ranked."""
    rows = docs.select("doc_id", F.explode(T.ngrams(T.tokens(F.col("text")), 1, 2)).alias("term")).join(assigned.select("doc_id", "topic_id"), "doc_id")
    counted = rows.groupBy("topic_id", "term").agg(count().alias("n"))
    order = Window.partitionBy("topic_id").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= words)


def representatives(documents: DataFrame, per_topic: int = 5) -> DataFrame:
    """Documents of the highest probability in each topic, ranked; a missing probability counts as 0."""
    order = Window.partitionBy("topic_id").orderBy(F.coalesce("probability", F.lit(0.0)).desc(), "doc_id")
    return documents.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_topic)


def flatten_representatives(topics: DataFrame) -> DataFrame:
    """Lists of documents (``topic_id, documents``: an array of structs) as rows with their rank from 1."""
    rows = topics.select("topic_id", F.posexplode("documents").alias("_p", "_d"))
    return rows.select("topic_id", (F.col("_p") + 1).alias("rank"), "_d.*")


def topics_by_year(documents: DataFrame, years: DataFrame) -> DataFrame:
    return documents.join(years, "doc_id").where("year is not null").groupBy("year", "topic_id").agg(count().alias("count"))


def topic_model(docs: DataFrame, backend: str = "lda", **options) -> dict:
    """Dispatch; backends that need models that aren't here say so."""
    if backend in ("bertopic", "hdbscan"):
        return {"status": "backend_unavailable", "backend": backend}
    if not long_enough(docs).limit(1).count():
        return {"status": "no_data", "backend": backend}
    if backend == "lda":
        topics, documents = lda(docs, **options)
        return {"status": "ok", "backend": backend, "topics": topics, "documents": documents}
    documents = kmeans(docs, **options)
    return {"status": "ok", "backend": backend, "topics": cluster_labels(docs, documents), "documents": documents}
