import pytest
from pyspark.sql import functions as F

from paperloom.operators import identity, store

ARRIVAL = "seq long, openalex_id string, corpus_id string, title string, year int, venue string, citation_count int, round int, source string, keywords string, parent_id string, search_rank int"


@pytest.fixture(scope="module")
def filled(spark):
    rows = [(1, "W1", "1", "one", 2000, "V", 5, 0, "search", "k1", None, 1), (2, None, "1", "other", 1999, None, 0, 0, "citation", None, "W9", None), (3, "W1", "7", "late", 2001, None, 1, 1, "search", "k2", None, 2), (4, "W2", None, "two", 2005, "", 50, 1, "search", "k1", None, 3), (5, "", "", "none", 0, "", 0, 1, "search", "k1", None, 1)]
    return store.upsert(None, spark.createDataFrame(rows, ARRIVAL))


def test_upsert_merges_ids_and_history(filled):
    got = {r["store_id"]: r for r in store.history_columns(filled).collect()}
    assert set(got) == {"1", "W2"}
    assert got["1"]["title"] == "one" and got["1"]["n_discoveries"] == 3 and got["1"]["source_keywords"] == ["k1", "k2"] and got["1"]["parent_ids"] == ["W9"]
    assert got["W2"]["first_round"] == 1


def test_upsert_in_rounds(spark, filled):
    more = spark.createDataFrame([(9, "W2", "W2", "again", 1, "", 1, 2, "citation", None, "1", None), (10, "W3", "3", "three", 2010, "", 1, 2, "search", "k3", None, 1), (11, "W1", "99", "known", 1, "", 1, 2, "search", "k3", None, 1)], ARRIVAL)
    got = {r["store_id"]: r for r in store.history_columns(store.upsert(filled, more)).collect()}
    assert got["W2"]["title"] == "two" and got["W2"]["n_discoveries"] == 2 and got["3"]["openalex_id"] == "W3"
    assert "99" not in got and got["1"]["n_discoveries"] == 4 and got["1"]["title"] == "one"
    assert store.stats(filled, 2).first()["keywords_used"] == 2


def test_scores_tags_and_ranks(spark, filled):
    ids = spark.createDataFrame([("1", 0.8), ("zz", 1.0)], "store_id string, score double")
    scored = store.set_scores(filled, ids, "llm_score")
    assert {r["store_id"]: r["llm_score"] for r in scored.collect()} == {"1": 0.8, "W2": None}
    with pytest.raises(ValueError, match="not a score"):
        store.set_scores(filled, ids, "title")
    tagged = store.add_tags(scored.withColumn("tags", F.array(F.lit("a"))).withColumn("is_seed", F.lit(False)), ids, ["a", "b"], seed=True)
    got = {r["store_id"]: r for r in tagged.collect()}
    assert got["1"]["tags"] == ["a", "b"] and got["1"]["is_seed"] and got["W2"]["tags"] == ["a"]
    assert store.by_tags(tagged, ["a", "b"], match_all=True).count() == 1
    ranked = store.importance(scored.withColumn("embedding_sim", F.when(F.col("store_id") == "1", 0.95)), 2010)
    assert store.top_k(ranked, 1).first()["store_id"] == "1"
    tiers = {r["store_id"]: r["tier"] for r in store.tiers(ranked).collect()}
    assert tiers == {"1": 1, "W2": 3}
    assert store.find(filled, spark.createDataFrame([("W1",), ("1",), ("no",)], "paper_id string")).count() == 2
    assert store.blend_in_domain({"relevance": 1.0, "recency": 1.0})["relevance"] == pytest.approx(0.425)
    assert store.strategy_sort(filled.withColumn("search_rank", F.lit(1)), 2010, "impact").first()["store_id"] == "W2"


def test_identity(spark):
    columns = "doi string, openalex_id string, s2_id string, s2_corpus_id string, title string, year int, source_rank int"
    rows = [("10.1/A", None, None, None, "x", None, 0), ("10.1/a", "W1", None, None, "y", 2001, 1), (None, None, "S", None, "x", 2001, 2)]
    merged = {r["key"]: r for r in identity.merge(spark.createDataFrame(rows, columns)).collect()}
    assert merged["doi:10.1/a"]["title"] == "x" and merged["doi:10.1/a"]["year"] == 2001 and merged["doi:10.1/a"]["openalex_id"] == "W1" and "s2_id:s" in merged
    a = spark.createDataFrame([(1, "Title One")], "id long, title string")
    b = spark.createDataFrame([(2, " title one "), (3, "New"), (4, "new"), (5, "")], "id long, title string")
    assert sorted(r["id"] for r in identity.merge_by_title(a, b).collect()) == [1, 3]
    papers = spark.createDataFrame([("W1", "10.1/a", None, "Deep nets for all"), ("W2", None, "2101.1", "Deep nets for you")], "id string, doi string, arxiv_id string, title string")
    asked = spark.createDataFrame([("q1", None, "doi:10.1/A", None, None), ("q2", None, None, "arXiv:2101.1", None), ("q3", None, None, None, "deep nets for All"), ("q4", None, None, None, "other")], "req string, id string, doi string, arxiv_id string, title string")
    got = {r["req"]: (r["id"], r["stage"]) for r in identity.resolve(asked, papers).collect()}
    assert got == {"q1": ("W1", 1), "q2": ("W2", 2), "q3": ("W1", 3), "q4": (None, None)}


def test_deep_search_and_sessions(spark):
    from paperloom.model.driver_tables import tables
    from paperloom.operators import deep

    t = tables(spark, "/root/testdata/sf0.001")
    scores = t.works.select(F.col("work_id").cast("string").alias("store_id"), (F.col("work_id") % 10 / 10.0).alias("score"))
    found = deep.deep_search(t, ["work 1", "work 22"], scores, 2002, seeds=3, top=20)
    rows = found.collect()
    assert 0 < len(rows) <= 20 and rows == sorted(rows, key=lambda r: -r["importance_score"])
    now = [0.0]
    held = deep.Sessions(ttl=10, clock=lambda: now[0])
    first = held.new()
    now[0] = 8
    held.get(first.session_id)
    now[0] = 17
    second = held.new()
    assert set(held.held) == {first.session_id, second.session_id}
    now[0] = 40
    third = held.new()
    assert set(held.held) == {third.session_id}


def test_session_tools_work_on_the_session(spark):
    from paperloom.model.driver_tables import tables
    from paperloom.plans import tools

    t = tables(spark, "/root/testdata/sf0.001")
    own = {"session_id": tools.run_tool("ds.session.new", t)["session_id"]}
    with pytest.raises(ValueError, match="empty"):
        tools.run_tool("ds.store.stats", t, own)
    found = tools.run_tool("ds.papers.search", t, own | {"keywords": "work 22", "limit": 5})
    assert found == {"added": 5, "total": 5}
    ids = sorted(r["store_id"] for r in tools.SESSIONS.get(**own).rows.select("store_id").collect())
    assert tools.run_tool("ds.papers.judge", t, own | {"scores": {ids[0]: 0.9, ids[1]: 0.1, "none": 1.0}})["evaluated"] == 2
    assert tools.run_tool("ds.store.seeds.mark", t, own | {"paper_ids": ids[0]}) == {"seeds": 1}
    more = tools.run_tool("ds.citations.fetch_refs", t, own | {"limit": 3})
    assert more["added"] > 0 and more["total"] == 5 + more["added"]
    stats = tools.run_tool("ds.store.stats", t, own).first()
    assert (stats["total_papers"], stats["search_papers"], stats["evaluated_count"]) == (more["total"], 5, 2)
    kept = {r["store_id"]: (r["tags"], r["is_seed"], r["is_evaluated"], r["llm_score"]) for r in tools.SESSIONS.get(**own).rows.collect()}
    assert kept[ids[0]] == (["seed"], True, True, 0.9) and kept[ids[2]] == ([], False, False, None)


def test_fuzzy_titles_meet_whatever_their_first_word_and_length(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    titles = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["x" * 62, "y" * 7, " Z "]
    asked = []
    for t in titles:
        for _ in range(4):
            letters = list(t)
            for _ in range(rng.randrange(0, 1 + max(1, len(t) // 14))):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            asked.append("".join(letters).upper())
    asked += ["x" * 63, "the " + titles[0], "q" + titles[1]]
    papers = spark.createDataFrame([(str(n), None, None, t) for n, t in enumerate(titles)], "id string, doi string, arxiv_id string, title string")
    requests = spark.createDataFrame([(n, None, None, None, t) for n, t in enumerate(asked)], "req int, id string, doi string, arxiv_id string, title string")
    score = lambda a, b: round(SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio(), 3) if a and b else -1.0
    best = {n: max((score(a, t), -int(m), m) for m, t in ((str(m), t) for m, t in enumerate(titles))) for n, a in enumerate(asked)}
    for strict in (True, False):
        got = {r["req"]: r["score"] for r in identity.resolve(requests, papers, strict).collect()}
        want = {n: x[0] if asked[n] and (x[0] >= identity.STRICT_TITLE or not strict) else None for n, x in best.items()}
        assert got == want
    assert sum(v is not None and v < 1 for v in want.values()) > 50


def test_lookups_by_id_and_doi(spark):
    papers = spark.createDataFrame([("W1", "https://doi.org/10.1/A", "one"), ("W2", None, "two"), ("W3", "10.1/a", "three"), (None, "10.9/z", "none")], "id string, doi string, title string")
    asked = spark.createDataFrame([(0, "W2"), (1, "none"), (2, "W1"), (3, "W2"), (4, None)], "pos int, id string")
    assert [r["title"] for r in identity.get_by_ids(asked, papers).collect()] == ["two", None, "one", "two", None]
    dois = spark.createDataFrame([("doi:10.1/A",), ("10.1/a",), ("",), (None,)], "doi string")
    assert [r["id"] for r in identity.get_by_doi(dois, papers).collect()] == ["W1", "W3"] and identity.get_by_doi(dois, papers, 1).count() == 1
    known = spark.createDataFrame([(1, "s1", "5"), (2, "", "6"), (3, None, None), (4, None, "")], "req int, s2_id string, s2_corpus_id string")
    found = spark.createDataFrame([(3, None, "7"), (1, "other", None)], "req int, s2_id string, s2_corpus_id string")
    assert {r[0]: r[1] for r in identity.s2_identifiers(known, found).collect()} == {1: "s1", 2: "CorpusId:6", 3: "CorpusId:7", 4: None}
    assert identity.s2_identifiers(known).where("s2_identifier is null").count() == 2


def test_second_source_where_the_first_found_too_few(spark):
    works = spark.createDataFrame([("A", 900), ("B", 900), ("C", 5), ("D", None), ("E", 301)], "work_id string, citation_count int")
    kind = "work_id string, id string, title string"
    first = spark.createDataFrame([("A", "a1", "One")] + [("B", f"b{n}", f"t{n}") for n in range(700)] + [("C", "c1", "x")] + [("E", f"e{n}", f"t{n}") for n in range(500)], kind)
    second = spark.createDataFrame([("A", "s2", " one "), ("A", "s3", "New"), ("A", "s4", "new "), ("A", "s5", ""), ("B", "s6", "new"), ("C", "s7", "new"), ("D", "s8", None), ("D", "s9", "x"), ("E", "s10", "new")], kind)
    got = {tuple(r) for r in identity.supplemented(works, first, second).where("id like 's%'").collect()}
    assert got == {("A", "s3", "New"), ("D", "s9", "x"), ("E", "s10", "new")}


def test_edge_lists(spark, filled):
    edges = spark.createDataFrame([("1", [("5", "t"), ("", "u"), (None, "v")]), ("W2", None), ("none", [("8", "w")])], "store_id string, edges array<struct<corpus_id: string, title: string>>")
    with_refs = store.set_edges(filled, edges, "references")
    assert {r["store_id"]: r["ids"] for r in store.edge_ids(with_refs, "references").collect()} == {"1": ["5"], "W2": []}
    again = store.set_edges(with_refs, spark.createDataFrame([("W2", [("6", "x")])], edges.schema), "references")
    assert {r["store_id"]: r["ids"] for r in store.edge_ids(again, "references").collect()} == {"1": ["5"], "W2": ["6"]}
    with pytest.raises(ValueError):
        store.set_edges(filled, edges, "tags")


def test_ranks_over_many_parts(spark):
    rows = [(i, (i * 7919) % 101, float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a long, rank_ double").repartition(13)
    got = {r["id"]: r["rank"] for r in store.ranked(df, "rank", F.desc("rank_"), "a", "id").collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1], r[0])), 1)}
    assert got == want
    assert store.ranked(df.where("id < 0"), "rank", "id").columns == ["id", "a", "rank_", "rank"] and store.ranked(df.where("id < 0"), "rank", "id").count() == 0
    papers = spark.createDataFrame([("a", 3, 2000, 5), ("b", 0, 2000, 5), ("c", None, 2000, 5), ("d", 9, 2000, 5), ("e", 3, 2000, 5)], "store_id string, search_rank int, year int, citation_count int")
    assert [r["store_id"] for r in store.strategy_sort(papers, 2020).collect()] == ["a", "e", "d", "b", "c"]
    again = spark.createDataFrame([("c", 8.0), ("b", 4.0)], "store_id string, score double")
    assert [r["store_id"] for r in store.strategy_sort(papers, 2020, rerank=again).collect()][:2] in (["a", "c"], ["c", "a"])


def test_fuzzy_titles_of_common_words_meet_few_others():
    """Titles of the same two words and a number share pieces with all others, but only near numbers are compared."""
    from collections import Counter
    from difflib import SequenceMatcher

    titles = [f"small plate {n}" for n in range(100000, 103000, 3)]
    asked = titles[::100]
    wanted = Counter(k for a in asked for k in identity.title_pieces(a))
    met = sum(wanted[k] for t in titles for k in identity.title_keys(t))
    alike = [(a, t) for a in asked for t in titles if SequenceMatcher(None, a, t).ratio() >= identity.STRICT_TITLE]
    assert all(set(identity.title_pieces(a)) & set(identity.title_keys(t)) for a, t in alike)
    assert len(alike) > 2 * len(asked) and met < 8 * len(alike) < len(asked) * len(titles)
