"""Every registered query that has SQL gives the rows DuckDB gives."""

import duckdb
import pytest

from paperloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row)) for row in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", ["keyphrase_candidates", "keyphrases_tfidf", "link_extract", "html_text", "hash_embed", "fuzzy_title", "communities"])
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_nearest_vectors_with_ties(spark):
    """Copies of a vector tie whatever partition they stand in, and the smallest ids win."""
    import numpy as np

    from paperloom.operators import embed

    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 12))
    rows = [(i, base[i % 3 if i % 2 else i % 30].tolist()) for i in range(400)]
    for parts in (1, 7):
        v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(parts)
        got = {(r["query_id"], r["id"]) for r in embed.nearest(v, v.where("id % 100 = 0"), top=10, block=3).collect()}
        want = set()
        for q in range(0, 400, 100):
            cosine = {i: round(float(np.dot(rows[q][1], x) / np.linalg.norm(rows[q][1]) / np.linalg.norm(x)), 9) for i, x in rows}
            want |= {(q, i) for i in sorted(cosine, key=lambda i: (-cosine[i], i))[:10]}
        assert got == want


def test_fuzzy_titles_against_every_pair(spark):
    from difflib import SequenceMatcher

    from paperloom.operators import identity

    names = ["deep learning of spin glasses", "Deep learning of spin glass", "the deep learning of spin glasses", "graph theory", "Graph theories", "a graph theory", "x", "", None, "deep learning of spin glasses!"]
    papers = [(str(i), n) for i, n in enumerate(names)]
    asked = [(i, n) for i, n in enumerate(["DEEP LEARNING OF SPIN GLASSES", "eep learning of spin glasses", "graph theory.", "nothing alike", "", None, "X"])]
    none = ", cast(null as string) doi, cast(null as string) arxiv_id"
    spark.createDataFrame(papers, "id string, title string").createOrReplaceTempView("known_titles")
    spark.createDataFrame(asked, "req int, title string").createOrReplaceTempView("asked_titles")
    got = {r["req"]: (r["id"], r["score"]) for r in identity.resolve(spark.sql(f"select req, cast(null as string) id, title{none} from asked_titles"), spark.sql(f"select id, title{none} from known_titles")).collect()}
    for req, title in asked:
        scores = [(-round(SequenceMatcher(None, (title or "").lower().strip(), n.lower().strip()).ratio(), 3), i) for i, n in papers if title and n]
        best = min(scores, default=None)
        assert got[req] == ((best[1], -best[0]) if best and -best[0] >= identity.STRICT_TITLE else (None, None))
