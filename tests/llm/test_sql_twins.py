"""The corpus queries that SQL can express give the rows DuckDB gives: on test tables, and on small tables of odd cases."""

import random

import duckdb
import pytest

from paperloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark")


def same(spark, folder, name):
    c = duckdb.connect()
    for t in TABLES:
        try:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
        except duckdb.IOException:  # the small tables of a case are only those that it needs
            pass
    got = queries.queries()[name](spark, folder).toPandas()
    want = c.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda f: sorted(repr(row) for row in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(got) == plain(want)
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_test_tables(spark, name):
    assert len(same(spark, SF, name)) > 0


def test_decontamination_of_odd_cases(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("alpha Beta gamma delta é straße 12 zeta".split()) for _ in range(n))
    items = [text(n) for n in (3, 12, 13, 14, 40, 90)] + [None, "", "- . !", "one", "ONE two"]
    docs = [None, "", "...", "one", "one two", *items[:6], *(text(n) for n in (5, 40, 300, 600))]
    docs += [f"{text(30)} {item}, {text(9)} {item}" for item in items[:6]]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = same(spark, str(tmp_path), "op4_decontaminate")
    assert got["contaminated"].sum() > 5


def test_vectors_of_odd_cases(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(base[i % 12] + rng.normal(size=16) * s).tolist() for i in range(150) for s in (0.05, 0.2, 0.4)[i % 3 : i % 3 + 1]]
    rows += [rows[0], rows[0], None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = same(spark, str(tmp_path), "op7_embedding_dedup")
    assert got["n_links"].sum() > 100 and 12 <= got["kept"].sum() < 150


def test_near_duplicates_of_odd_cases(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice([f"w{k}" for k in range(300)])
    docs = [None, "", " \t\n", "One two", "one  TWO", "two one", "a b c d e", "A B C D E"]
    for _ in range(25):
        own = [word() for _ in range(rng.randrange(5, 120))]
        docs += [" ".join(own), "  ".join(own).upper()]
        for changes in (1, 2, 4):
            near = list(own)
            for _ in range(changes):
                near[rng.randrange(len(near))] = word()
            docs.append(" ".join(near))
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = same(spark, str(tmp_path), "op9_near_duplicates")
    assert 20 < got["kept"].sum() < len(docs) - 25
