import random

import pytest
from pyspark.sql import functions as F

from paperloom.model import schema
from paperloom.model.tables import Tables
from paperloom.operators import authors, bibliometrics, citations, coword, graph, keyphrases, landscape, macro, readiness, search, topics
from paperloom.plans import tools


def author(i, name, place, country=None, corresponding=None):
    home = [(f"I{country}", f"Inst {country}", country, "education")] if country else []
    return (f"https://openalex.org/{i}", name, None, place, "first" if place == 1 else "last", corresponding, home)


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        ("https://openalex.org/W1", None, "Quantum spin liquids", 2023, "2023-01-01", "article", 10, True, ("S1", "Journal A", "journal", None), [("T1", "Spin", 0.9)], "open access spin <mml:mi>x</mml:mi>", None, [author("A1", "Ann", 1, "US", True), author("A2", "Bob", 2, "GB")], ["W0", "W00"]),
        ("https://openalex.org/W2", None, "Open access spin", 2024, "2024-01-01", "article", 4, False, ("S1", "Journal A", "journal", None), [("T1", "Spin", 0.5)], None, {"spin": [1], "quantum": [0]}, [author("A1", "Ann", 1, "US")], ["W0"]),
        ("https://openalex.org/W3", "10.1/x", "Third", 2024, "2024-02-01", "review", 1, True, None, [], "", None, None, []),
    ]
    return spark.createDataFrame(rows, schema.WORK)


@pytest.fixture(scope="module")
def t(works):
    return Tables.from_works(works)


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_bibliometrics(t):
    o = bibliometrics.overview(t).first()
    assert (o["total_papers"], o["total_citations"], o["median_citations"], o["p90"]) == (3, 15, 4.0, pytest.approx(8.8))
    annual = {r["year"]: r for r in bibliometrics.annual_impact(t).collect()}
    assert annual[2024]["cumulative_papers"] == 3 and annual[2024]["cumulative_citations"] == 15 and not annual[2024]["year_is_incomplete"]
    assert bibliometrics.growth_rate(t).first()["annual_growth_rate"] == pytest.approx(100)
    best = bibliometrics.top_authors(t).first()
    assert (best["id"], best["n_papers"], best["total_citations"], best["h_index"]) == ("A1", 2, 14, 2)
    assert bibliometrics.top_papers(t).first()["authors"] == "Ann; Bob"
    assert rows(bibliometrics.top_sources(t), "id", "n_papers") == [("S1", 2)]
    topic = bibliometrics.top_topics(t).first()
    assert topic["frequency"] == 2 and topic["percentage"] == pytest.approx(200 / 3)
    assert bibliometrics.annual_diagnostics(bibliometrics.annual_impact(t))


def test_macro(t):
    assert [r["country_code"] for r in macro.countries(t).collect()] == ["US", "GB"]
    assert rows(macro.countries(t, "fractional", min_count=0), "country_code", "n_papers") == [("GB", 0.5), ("US", 1.5)]
    assert rows(macro.corresponding(t), "country_code", "scp", "mcp") == [("US", 1, 1)]
    assert rows(macro.edges(t, "country_code"), "source", "target", "weight") == [("GB", "US", 1)]
    assert rows(macro.institutions(t), "id", "name", "n_papers") == [("IGB", "Inst GB", 1.0), ("IUS", "Inst US", 2.0)]
    assert macro.overview(t).first()["multi_country"] == 1
    assert rows(macro.density(t), "country_code", "n_institutions") == [("GB", 1), ("US", 1)]
    assert rows(macro.unpivot_corresponding(macro.corresponding(t)), "kind", "papers") == [("mcp", 1), ("scp", 1)]
    wide = macro.pivot(macro.country_by_year(t), "year", "country_code", "n_papers")
    assert rows(wide, "year", "GB", "US") == [(2023, 1, 1), (2024, 0, 1)]


def test_authors(t):
    found = {r["id"]: r for r in authors.landscape(t).collect()}
    assert found["A1"]["first_author_papers"] == 2 and found["A1"]["last_author_papers"] == 1 and found["A1"]["primary_institution"] == "Inst US"
    assert found["A2"]["collaborator_count"] == 1 and found["A2"]["topic_count"] == 1
    assert rows(authors.author_topics(t), "author_id", "topic_id", "n") == [("A1", "T1", 2), ("A2", "T1", 1)]


def test_citations(t, spark):
    assert rows(citations.reference_frequency(t), "rank", "referenced_work") == [(1, "W0"), (2, "W00")]
    o = citations.overview(t).first()
    assert o["records_with_references"] == 2 and o["max_citations"] == 10
    assert rows(citations.co_citation(t), "ref_id", "co_citation_count", "in_store") == [("W0", 2, False)]
    assert citations.network_stats(t).first()["in_domain_ratio"] == 0.0
    papers = spark.createDataFrame([(1, 2000, 3), (2, None, 9), (3, 2010, 0)], "id int, year int, citation_count int")
    assert rows(citations.filter_papers(papers, 2005), "id") == [(2,), (3,)]
    assert rows(citations.filter_papers(papers, 2005, keep_null_year=False), "id") == [(3,)]


def test_reference_queries_over_all_references(spark):
    """The whole table is asked, not a share of the ids."""
    from paperloom.model.driver_tables import tables
    from paperloom.plans import registry

    sf = "/root/testdata/sf0.001"
    t, asked = tables(spark, sf), registry.queries()
    assert asked["references_of"](spark, sf).where("work_id % 100 <> 0").count() > 0
    assert asked["citations_of"](spark, sf).where("cited_id % 10 <> 0").count() > 0
    counts = citations.co_citation(t).select("ref_id", "co_citation_count")
    assert asked["missing_references"](spark, sf).join(counts, ["ref_id", "co_citation_count"], "left_anti").count() == 0
    assert asked["missing_references_of_type"](spark, sf).count() > 0


def test_edges_of_rare_terms(spark):
    """Pairs of terms outside the first ones count if they are heavy enough, exactly as when all are paired."""
    rng = random.Random(3)
    docs = [(n, f"t{rng.choice(range(rng.choice([3, 12, 30])))}") for n in range(80) for _ in range(6)]
    terms = spark.createDataFrame(docs, "doc_id int, term string")
    allowed = coword.allowed_terms(terms.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("doc_id").alias("doc_count")), 1)
    plain = lambda **o: [tuple(r) for r in coword.edges(terms, allowed, **o).collect()]
    for top in (5, 40, 10_000):
        assert plain(top=top, first=4) == plain(top=top, first=10_000)


def test_readiness(t):
    status = {x["tool"]: x["status"] for x in readiness.tool_status(t)}
    assert status["analysis.coword"] == "ready" and status["analysis.bibliometrics"] == "ready"
    cover = {r["field"]: r["records"] for r in readiness.coverage(t).collect()}
    assert cover == {"title": 3, "abstract": 2, "year": 3, "authors": 2, "author_institutions": 2, "source": 2, "topics": 2, "referenced_works": 2}
    assert readiness.preflight(t)["safe_defaults"]["min_count"] == 1
    assert readiness.safe_defaults(3000) == {"min_count": 2, "nr_topics": None, "max_docs": 2000, "min_papers": 2}


def test_empty_collection(spark):
    t = Tables.from_works(spark.createDataFrame([], schema.WORK))
    assert bibliometrics.overview(t).first()["total_papers"] == 0
    assert bibliometrics.annual_impact(t).count() == macro.countries(t).count() == authors.landscape(t).count() == 0
    assert all(x["status"] == "missing" for x in readiness.tool_status(t))
    assert citations.overview(t).first()["zero_citation_share"] is None


def test_coword_and_keyphrases(spark, t):
    docs = spark.createDataFrame([(1, "Quantum spin liquids. Open access to quantum spin."), (2, "We prove the existence of open access"), (3, "")], "doc_id long, text string")
    terms = coword.documents_terms(docs, F.col("text"), (1, 2))
    counts = {r["term"]: (r["count"], r["doc_count"]) for r in coword.term_counts(terms).collect()}
    assert counts["quantum spin"] == (2, 1) and counts["open access"] == (2, 2)
    allowed = coword.allowed_terms(coword.term_counts(terms), 2)
    kept = coword.edges(terms, allowed)
    assert ("access", "open", 2) in rows(kept, "source", "target", "weight")
    members = graph.communities(kept)
    assert coword.clusters(members, coword.term_counts(terms), kept).count() >= 1
    found = keyphrases.candidates(docs, F.col("text"))
    names = {r["term"] for r in found.collect()}
    assert "open access" in names and "prove the existence" not in names and "quantum spin liquids" in names
    best = keyphrases.nonredundant(keyphrases.tfidf(found), 5)
    assert best.groupBy("doc_id").count().where("count > 5").count() == 0
    aliases = spark.createDataFrame([("quantum spin", "qs")], "term string, canonical string")
    assert "qs" in {r["term"] for r in coword.documents_terms(docs, F.col("text"), (2, 2), aliases=aliases).collect()}


def test_keyphrases_of_accented_texts(spark):
    """The reference's rule: NFKD, lower case, all but ``[a-z0-9 ]`` to spaces."""
    import re
    import unicodedata

    texts = ["Café culture", "étude métrique", "\ufb01nite \uff46ield", "Über­blick naïveté"]
    want = [re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", unicodedata.normalize("NFKD", t).lower())).strip().split() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = keyphrases.candidates(docs, F.col("text"))
    names = {(r["doc_id"], r["term"]) for r in found.collect()}
    assert all(w in want[n] for n, term in names for w in term.split())
    assert {(0, "culture"), (2, "finite field"), (2, "finite"), (2, "field")} <= names and (0, "caf") not in names
    scores = keyphrases.lexical_ranked(found, docs)
    assert scores.where("doc_id = 2 and term = 'finite field'").first()["score"] > 1.0
    assert scores.where("score < 1").count() == 0


def test_hash_keyphrases_rank_all_candidates(spark, monkeypatch):
    """A phrase past the 60 most frequent candidates of its document can be among the best."""
    from paperloom.plans import scholar

    docs = spark.createDataFrame([(1, ". ".join(f"zebra{n} yonder{n}" for n in range(40)) + ". aardvark")], "doc_id long, text string")
    monkeypatch.setattr(scholar, "table", lambda *a: docs)
    ranked = []
    monkeypatch.setattr(scholar.kp, "hash_ranked", lambda found, texts: ranked.append(found) or found)
    monkeypatch.setattr(scholar.kp, "nonredundant", lambda scored: scored)
    scholar.keyphrases_hash(spark, "")
    assert ranked[0].count() == 121 and ranked[0].where("term = 'aardvark'").count() == 1


def test_topic_queries_are_not_cut(spark, monkeypatch):
    """The reference's vocabulary, and the operators' own iterations and topic counts."""
    import inspect

    from paperloom.plans import collections

    asked = {}

    def seen(name):
        def call(docs, **options):
            bound = inspect.signature(originals[name]).bind(docs, **options)
            bound.apply_defaults()
            asked.setdefault(name, []).append(dict(bound.arguments))
            raise StopIteration

        return call

    originals = {n: getattr(collections.cluster, n) for n in ("lda", "kmeans")}
    for name in originals:
        monkeypatch.setattr(collections.cluster, name, seen(name))
    for query in ("lda_topics", "representative_docs", "kmeans_topics"):
        with pytest.raises(StopIteration):
            collections.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert [(x["max_features"], x["iterations"], x["k"]) for x in asked["lda"]] == [(5000, 10, None)] * 2
    assert [(x["iterations"], x["k"]) for x in asked["kmeans"]] == [(20, None)]


def test_communities_and_components(spark):
    edges = [("a", "b", 3), ("b", "c", 3), ("a", "c", 3), ("x", "y", 2), ("c", "x", 1)]
    group = graph.greedy_communities(edges)
    assert group["a"] == group["b"] == group["c"] == 1 and group["x"] == group["y"] == 2
    assert graph.modularity(edges, group) >= graph.modularity(edges, dict.fromkeys(group, 1))
    df = spark.createDataFrame([("a", "b", 1), ("c", "b", 1), ("x", "y", 1)], "source string, target string, weight int")
    assert rows(graph.connected(df), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    # A path whose names fall from its far end to its least one, a loop, and one of two nodes.
    path = [("n000", "n070"), *((f"n{n:03}", f"n{n - 1:03}") for n in range(70, 1, -1)), ("z", "z"), ("zz", "zz"), ("zz", "zy")]
    found = rows(graph.connected(spark.createDataFrame(path, "source string, target string")), "node", "component")
    assert found == [*((f"n{n:03}", "n000") for n in range(71)), ("z", "z"), ("zy", "zy"), ("zz", "zy")]
    large = graph.communities(df, max_edges=2)
    assert rows(large, "term", "cluster", "method") == [(n, c, "components") for n, c in (("a", 1), ("b", 1), ("c", 1), ("x", 2), ("y", 2))]


def test_search(t, works):
    with pytest.raises(ValueError, match="constraint"):
        search.WorksRequest()
    with pytest.raises(ValueError, match="after"):
        search.WorksRequest(from_year=2, to_year=1)
    assert rows(search.search(t, search.WorksRequest(country="GB")), "work_id") == [("W1",)]
    assert rows(search.search(t, search.WorksRequest(query="spin", min_citations=5)), "work_id") == [("W1",)]
    assert search.get_work(works, "https://openalex.org/W2").first()["title"] == "Open access spin"
    assert search.authors_of(t, "W1", 2).first()["author_name"] == "Bob" and search.authors_of(t, "W1", 9).count() == 0
    assert search.plan(search.WorksRequest(from_year=2000))["count_from_aggregate"]
    dim = t.works.sparkSession.createDataFrame([(1, "T1", "Spin", "subfields/1", "Magnets", "fields/2", "Physics", "domains/3", "Physical Sciences")], "rank int, topic_id string, topic string, subfield_id string, subfield string, field_id string, field string, domain_id string, domain string")
    assert topics.resolve_topic(dim, "physical science").first()["filter"] == "topics.domain.id:domains/3"


def test_tools_and_landscape(t):
    assert "analysis.macro" in tools.list_tools() and tools.describe("works.search")["schema"]["additionalProperties"] is False
    assert tools.preview(tools.run_tool("analysis.macro", t, {"counting": "fractional"}))["countries"]
    for bad in ({"counting": "none"}, {"top": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            tools.run_tool("analysis.macro", t, bad)
    with pytest.raises(ValueError, match="missing"):
        tools.run_tool("works.get", t, {})
    done = landscape.science_landscape(t)
    assert not done["failed"] and landscape.summarize({"citation_overview": done["results"]["citation_overview"]})["citation_overview"]["overview"]


def test_country_names(spark, t):
    df = spark.createDataFrame([(1, "de"), (2, "GB"), (3, "usa"), (4, "zz"), (5, ""), (6, None), (7, "qqq")], "id int, country_code string")
    got = {r["id"]: (r["country_iso3"], r["country_name"]) for r in macro.with_countries(df).collect()}
    assert got == {1: ("DEU", "Germany"), 2: ("GBR", "United Kingdom"), 3: ("USA", "United States"), 4: ("", "zz"), 5: ("", ""), 6: ("", ""), 7: ("QQQ", "qqq")}
    assert tools.run_tool("analysis.macro", t)["countries"].columns[:3] == ["country_code", "country_iso3", "country_name"]


def test_lists_with_ranks(spark):
    from paperloom.operators import cluster, keyphrases

    topics_ = spark.createDataFrame([(1, [("a", 0.9), ("b", 0.1)]), (2, [])], "topic_id int, documents array<struct<doc_id: string, probability: double>>")
    assert rows(cluster.flatten_representatives(topics_), "topic_id", "rank", "doc_id") == [(1, 1, "a"), (1, 2, "b")]
    ranked = spark.createDataFrame([(1, 1, "neural network", 0.9), (1, 2, "graph", 0.5), (2, 1, "café", 0.4)], "doc_id int, rank int, term string, score double")
    given = spark.createDataFrame([(1, [("Neural Network", "method", ["nn"]), ("", "x", None), ("graph theory", "topic", ["graph", "theory"]), ("late", "x", None)]), (2, [("...", "x", None)])], "doc_id int, items array<struct<term: string, category: string, source_terms: array<string>>>")
    found = {(r["doc_id"], r["term"]): (r["llm_rank"], r["score"], r["source_terms"]) for r in keyphrases.refine(given, ranked, 3).collect()}
    assert found == {(1, "neural network"): (1, 0.9, "nn"), (1, "graph theory"): (3, 0.5, "graph;theory"), (2, "café"): (None, 0.4, None)}


def test_names_of_entities(spark):
    known = spark.createDataFrame([("https://openalex.org/I1", "Oxford Brookes", 9, 1), ("I2", "University of Oxford", 99, 5), ("I3", "oxford", 1, 1), ("I4", None, 5, 5), ("I5", "Not Oxford Town", 2, 1)], "id string, display_name string, works_count int, cited_by_count int")
    got = search.resolve_entity(known, " Oxford ")
    assert (got["id"], [c["id"] for c in got["candidates"]], len(got["diagnostics"])) == ("I3", ["I3", "I1", "I2"], 1)
    with pytest.raises(ValueError):
        search.resolve_entity(known, "Cambridge")


def test_resolve_conference_and_deep_tools(t):
    title = t.works.where("work_id = 'W2'").first()["title"]
    assert tools.run_tool("citations.resolve", t, {"work_id": "W2"}).first()["matched_by"] == "id"
    found = tools.run_tool("citations.resolve", t, {"title": title.upper()}).first()
    assert (found["work_id"], found["matched_by"], found["score"]) == ("W2", "title", 1.0)
    with pytest.raises(ValueError, match="title"):
        tools.run_tool("citations.resolve", t, {})
    one = t.works.where("source_name <> '' and year is not null").first()
    papers = tools.run_tool("conferences.papers", t, {"venue": one["source_name"], "year": one["year"]})
    assert papers["source"] == "dblp" and papers["request"].endswith(f"year:{one['year']}:") and one["work_id"] in [r["work_id"] for r in papers["papers"].collect()]
    assert tools.run_tool("search.deep", t, {"keywords": "spin", "current_year": 2024, "scores": {"W1": 0.9}}).count() > 0


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def ranked_both_ways(spark, ranked):
    """What ``ranked`` makes of the candidates as they are returned, and of the same rows without their arrays."""
    docs = spark.createDataFrame([(n % 37, " ".join(f"{'spin' if k % 3 else 'quantum'} liquid{(n * k) % 11} the graph{k % (n + 2)} s x mml." for k in range(n))) for n in range(40)] + [(50, None), (51, "Ｇraph <b>groups</b> o’brien x y")], "doc_id long, text string")
    found = keyphrases.candidates(docs, F.col("text"))
    return tuple(sorted(rows(keyphrases.nonredundant(ranked(x, docs), 4), "doc_id", "rank", "term", "score")) for x in (found, found.select("*")))


def test_keyphrases_by_tfidf_shuffle_no_candidates(spark):
    """Candidates are counted where their texts are; the choice is the same from all of them and from those that can win."""
    docs = spark.createDataFrame([(1, "Quantum spin liquids. Open access")], "doc_id long, text string")
    plan = plan_of(keyphrases.candidates(docs, F.col("text")))
    assert "hashpartitioning(doc_id" in plan and "term" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    got, want = ranked_both_ways(spark, lambda found, docs: keyphrases.tfidf(found))
    assert got == want and len(got) > 100


def test_phrases_that_may_be_chosen(spark):
    """Whatever the frequencies are, the phrases left out are never chosen."""
    import random

    rng = random.Random(5)
    for _ in range(20):
        words = [rng.choice("spin graph group liquid quantum field".split()) for _ in range(60)]
        found = keyphrases.most_frequent(keyphrases.phrase_counts(" ".join(words)), 40)
        kept = keyphrases.tfidf_contenders(found, 1000, 1000, 5)
        frame = spark.createDataFrame([(1, *x) for x in found], "doc_id long, term string, n long, words int")
        df = spark.createDataFrame([(x[0], rng.choice([1, 2, 1000])) for x in found], "term string, doc_frequency long")
        best = lambda f: rows(keyphrases.nonredundant(keyphrases._tfidf_scored(f, df, 1000), 5), "rank", "term")
        assert best(frame) == best(frame.where(F.col("term").isin([x[0] for x in kept])))


def test_keyphrases_by_hash_shuffle_no_vectors(spark):
    """Scores are made where a document's candidates and text meet, as from vectors of both."""
    from paperloom.functions import udfs as U

    docs = spark.createDataFrame([(1, "Quantum spin liquids, quantum Spin_1. Open access"), (1, "spin spin"), (2, None)], "doc_id long, text string")
    found = keyphrases.candidates(docs, F.col("text"))
    ranked = keyphrases.hash_ranked(found, docs)
    assert not any("term" in x or "p#" in x for x in plan_of(ranked).splitlines() if "Exchange" in x)
    cosine = F.coalesce(U.cosine(U.hash_vector_udf(F.col("text")), U.hash_vector_udf(F.col("term"))), F.lit(0.0))
    want = found.join(docs, "doc_id").withColumn("score", cosine + F.least(F.lit(0.06), 0.02 * (F.col("words") - 1)))
    assert rows(ranked, "doc_id", "term", "words", "candidate_count", "score") == rows(want, "doc_id", "term", "words", "n", "score")
