"""Embeddings of works: the text rule, the hash backend, the index table and saved matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import udfs as U

FIELDS = ("title", "abstract", "topics")
BACKENDS = ("hash",)


def text_fields(wanted: list[str] | tuple[str, ...]) -> list[str]:
    """Fields once each, in the fixed order that texts are joined in."""
    if unknown := set(wanted) - set(FIELDS):
        raise ValueError(f"unknown text fields: {sorted(unknown)}")
    return [f for f in FIELDS if f in set(wanted)]


def work_texts(t, fields: list[str] | tuple[str, ...] = ("title", "abstract"), min_words: int = 1, max_docs: int | None = None) -> DataFrame:
    """``work_id``, ``pos``, ``text`` of works with enough words: title, abstract, topic names, joined by spaces."""
    rows, wanted = t.works, text_fields(fields)
    if "topics" in wanted:
        names = t.topics.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tpos", "topic"))), lambda x: x["topic"]), " ").alias("topics"))
        rows = rows.join(names, "work_id", "left")
    text = F.array_join(F.filter(F.array(*[F.trim(F.coalesce(F.col(f), F.lit(""))) for f in wanted]), lambda x: x != ""), " ")
    rows = rows.withColumn("text", text).where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= min_words)
    return rows.orderBy("pos").limit(max_docs) if max_docs else rows


def embed_works(t, fields: tuple[str, ...] = ("title", "abstract"), backend: str = "hash", dimensions: int = 384, normalize: bool = True, min_words: int = 1) -> tuple[DataFrame | None, list[str]]:
    """Index rows with their vectors, and diagnostics. Backends that need models or services are unavailable here."""
    if backend not in BACKENDS:
        return None, [f"backend_unavailable: {backend}"]
    rows = work_texts(t, fields, min_words)
    return rows.select("work_id", "title", "year", F.col("source_name").alias("source"), F.length("text").alias("text_chars"), F.size(F.split(F.trim("text"), r"\s+")).alias("text_words"), U.hash_vector_udf(F.col("text"), dimensions, normalize).alias("embedding")), []


def load_embeddings(spark, path: str, expected_rows: int) -> tuple[DataFrame | None, list[str]]:
    """Saved vectors, if their number fits; else None and why."""
    rows = spark.read.parquet(path)
    n = rows.count()
    return (rows, []) if n == expected_rows else (None, [f"saved embeddings have {n} rows, the collection {expected_rows}; computing them anew"])


def l2_normalize(vector):
    """Unit length inside the JVM; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, block: int = 2048) -> DataFrame:
    """Exact nearest neighbours of a stated query set against all rows, in blocks of queries: ``query_id``, ``id``, ``cosine``.

    Queries travel to the rows in blocks of bounded size; each task keeps its best ``top`` per query before the shuffle. Cosines
    are rounded to 12 places, so that equal vectors tie wherever they stand; the smaller id wins.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    out = None
    asked = [(r["id"], r["embedding"]) for r in queries.select("id", "embedding").toLocalIterator()]
    for start in range(0, len(asked), block):
        ids = np.array([i for i, _ in asked[start : start + block]])
        q = np.array([v for _, v in asked[start : start + block]], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(parts, ids=ids, q=q):
            for part in parts:
                if not len(part):
                    continue
                part = part.sort_values("id", kind="stable")
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                c = np.round(q @ x.T, 12)
                k = min(top, c.shape[1])
                least = -np.partition(-c, k - 1, axis=1)[:, k - 1 : k]
                above, tied = c > least, c == least
                rows, pick = np.nonzero(above | tied & (tied.cumsum(1) <= k - above.sum(1, keepdims=True)))
                yield pd.DataFrame({"query_id": ids[rows], "id": part["id"].to_numpy()[pick], "cosine": c[rows, pick]})

        found = vectors.select("id", "embedding").mapInPandas(best, "query_id bigint, id bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).drop("n")
