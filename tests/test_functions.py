import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import text as T
from paperloom.functions import udfs as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "doi"), [("https://doi.org/10.1/A", "10.1/A"), (" doi:10.1/x ", "10.1/x"), ("", None), (None, None), ("DOI: 10.2/y", "10.2/y")])
def test_doi_key(spark, raw, doi):
    assert one(spark, S.doi_key(F.lit(raw).cast("string"))) == doi


@pytest.mark.parametrize(("raw", "key"), [("https://arxiv.org/abs/2101.1?x=2", "2101.1"), ("http://ARXIV.org/pdf/2101.2.pdf", "2101.2"), ("arXiv:2101.3#s", "2101.3"), ("  ", None)])
def test_arxiv_key(spark, raw, key):
    assert one(spark, S.arxiv_key(F.lit(raw))) == key


def test_first_truthy_skips_empty_values(spark):
    assert one(spark, S.first_truthy(F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "b"
    assert one(spark, S.first_truthy(F.lit(0), F.lit(7), kind="number")) == 7
    empty = F.array().cast("array<string>")
    assert one(spark, S.first_truthy(empty, F.array(F.lit("x")), empty, kind="array")) == ["x"]


@pytest.mark.parametrize(("values", "h"), [([], 0), ([0, 0], 0), ([10], 1), ([3, 3, 3, 1], 3), ([5, 4, 4, 4, 1], 4)])
def test_h_index(spark, values, h):
    assert one(spark, S.h_index(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>"))) == h


def test_scores(spark):
    assert one(spark, S.sigmoid(F.lit(3.0), 3, 2)) == 0.5
    assert one(spark, S.sigmoid(F.lit(-1e6), 0, 1)) == 0.0
    assert one(spark, S.recency(F.lit(2024), 2020)) == 1.0
    assert one(spark, S.recency(F.lit(None).cast("int"), 2020)) == 0.0
    assert one(spark, S.recency(F.lit(2013), 2020)) == 0.5
    assert one(spark, S.centrality(F.lit(0))) == 0.0
    assert one(spark, S.centrality(F.lit(50))) == pytest.approx(0.5)
    assert one(spark, S.in_domain_score(F.lit(4), F.lit(8))) == pytest.approx(1.0)
    assert one(spark, S.in_domain_score(F.lit(4), F.lit(0))) is None


def test_supplement_rules(spark):
    assert one(spark, S.should_supplement_lookup(F.lit(10), F.lit(0), 100)) is True
    assert one(spark, S.should_supplement_lookup(F.lit(500), F.lit(1), 100)) is False
    assert one(spark, S.should_supplement_lookup(F.lit(90), F.lit(60), 100)) is True
    assert one(spark, S.should_supplement_fetch(F.lit(300), F.lit(1))) is False
    assert one(spark, S.should_supplement_fetch(F.lit(900), F.lit(500))) is True


def test_paper_key_order(spark):
    none = F.lit(None).cast("string")
    assert one(spark, S.paper_key(F.lit("10.1/A"), F.lit("W1"), none, none, F.lit("T"), F.lit(1))) == "doi:10.1/a"
    assert one(spark, S.paper_key(F.lit(""), none, F.lit("S1"), none, F.lit("T"), F.lit(1))) == "s2_id:s1"
    assert one(spark, S.paper_key(none, none, none, none, F.lit(" The T "), F.lit(2001))) == "title:the t:2001"


def test_identifiers(spark):
    assert one(spark, S.work_identifier(F.lit("https://openalex.org/W1"))) == "W1"
    assert one(spark, S.work_identifier(F.lit("doi:10.1/x"))) == "https://doi.org/10.1/x"
    assert one(spark, S.s2_identifier(F.lit("123"))) == "CorpusId:123"
    assert one(spark, S.s2_identifier(F.lit("arXiv:2101.1"))) == "ARXIV:2101.1"
    assert one(spark, S.s2_identifier(F.lit("10.1/x"))) == "DOI:10.1/x"
    assert one(spark, S.pid_map(F.lit("doi:10.1/a:b omid:br/1 junk"))) == {"doi": "10.1/a:b", "omid": "br/1"}


def test_inverted_index_keeps_one_token_a_place(spark):
    index = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0)), F.lit("c"), F.array(F.lit(2), F.lit(3)))
    assert one(spark, S.inverted_index_text(index)) == "a b c c"


def test_topic_rules(spark):
    match = lambda q, c: one(spark, S.hierarchical_match(F.lit(q), F.lit(c)))
    assert match("Social Sciences", "social science") and match("computer", "Computer Science")
    assert not match("science", "Computer Science") and not match("", "x")
    assert one(spark, S.topic_filter(F.lit("https://openalex.org/fields/17"))) == "topics.field.id:fields/17"


def test_url_types(spark):
    kind = lambda u: one(spark, S.url_type(F.lit(u)))
    assert [kind(u) for u in ("https://x.github.io/a", "https://sites.google.com/v", "http://www.mit.edu", "https://me.org/x.edu", "nothing")] == ["github_pages", "google_sites", "institutional", "personal", "unknown"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), max_size=7))
def test_ngrams_and_pairs(spark, words):
    column = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    want = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert one(spark, T.ngrams(column, 1, 3)) == want
    got = [tuple(p) for p in one(spark, T.pairs(column))]
    assert got == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :]]


def test_ngram_bounds():
    with pytest.raises(ValueError, match="bounds"):
        T.ngrams(F.lit(None), 3, 2)


def test_terms_and_phrases(spark):
    assert one(spark, T.clean_term(F.lit("-A <b>x</b>  Qué-"))) == "a  x   qu"
    low = lambda t: one(spark, T.is_low_signal(F.lit(t)))
    assert low("mml spin") and low("ab cd") and low("data analysis") and not low("quantum spin")
    weak = lambda t: one(spark, T.is_weak_phrase(F.lit(t)))
    assert weak("prove existence") and weak("the spin") and weak("abc") and weak("z spin") and weak("")
    assert not weak("p adic l functions") and not weak("open access") and not weak("quantum")


def test_vectors_and_titles(spark):
    v = U.hash_vector("alpha beta alpha", 64)
    assert abs(v).sum() in (1.0, 3.0) and (U.hash_vector(None, 8) == 0).all()
    row = spark.createDataFrame([("alpha beta", "")], "a string, b string").select(U.hash_vector_udf(F.col("a"), 32).alias("a"), U.hash_vector_udf(F.col("b"), 32).alias("b")).first()
    assert math.isclose(sum(x * x for x in row["a"]), 1, rel_tol=1e-5) and set(row["b"]) == {0.0}
    titles = spark.createDataFrame([("Deep nets", "deep nets "), ("Deep nets", "shallow"), (None, "x")], "a string, b string")
    scores = [r[0] for r in titles.select(U.title_score_udf("a", "b")).collect()]
    assert scores[0] == 1.0 and scores[1] < 0.5 and scores[2] is None
    assert one(spark, U.nfkd_udf(F.lit("é"))) == "é"
