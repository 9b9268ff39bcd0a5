import json

import pytest
from pyspark.sql import functions as F

from paperloom.sources import datasets, html_links, records


def test_load_guesses_and_drops_what_is_no_record(spark, tmp_path):
    (tmp_path / "papers.json").write_text(json.dumps([{"id": "W1", "title": "x", "cited_by_count": 3}, {"id": "W2"}]))
    found = datasets.load(spark, str(tmp_path))
    assert found.info()["records"] == 2 and found.rows.where("id = 'W1'").first()["cited_by_count"] == 3
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, str(tmp_path / "none"))


def test_save_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, title string")
    path = datasets.save(df, str(tmp_path), "works", "works search", {"query": "Deep Nets!"}, {"n": 1})
    assert "/works_deep-nets_" in path and path == datasets.save(df, str(tmp_path), "works", "works search", {"query": "Deep Nets!"})
    back = datasets.load(spark, path)
    assert back.rows.collect() == df.collect() and back.metadata["data_file"] == "data.parquet"
    files = datasets.save_analysis(spark, str(tmp_path / "a"), {"t": df.withColumn("x", F.array("id"))}, "# ok", ["note"])
    assert spark.read.csv(files["t"], header=True).first()["x"] == "[1]"


def test_links_and_listings(spark):
    html = '<a href="/2024.acl-long.1/">A <b>paper</b></a><a href="x.pdf">pdf</a><a href="c_paper.html">C</a><a>none</a><a href="/v1/p.html">P'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    links = html_links.extract_links(pages)
    assert [(r["href"], r["link_text"]) for r in links.orderBy("pos").collect()] == [("/2024.acl-long.1/", "A paper"), ("x.pdf", "pdf"), ("c_paper.html", "C"), ("/v1/p.html", "P")]
    assert html_links.acl_listing(links).first()["source_record_id"] == "2024.acl-long.1"
    assert html_links.acl_listing(links, "zzz").count() == 0
    assert html_links.cvf_listing(links).first()["pdf_url"] is None
    assert html_links.pmlr_listing(links).count() == 1
    assert html_links.plain_text("<p>a &amp;\n b</p><script>x</script>") == "a & b"


def test_homepages(spark):
    raw = spark.createDataFrame([("A", "x", "https://a.edu", "s"), ("", "x", "https://b.edu", "s"), ("C", "x", None, "s")], "name string, affiliation string, homepage string, scholarid string")
    assert [r["scholar_name"] for r in records.csrankings(raw).collect()] == ["A"]
    lines = spark.createDataFrame([("# c",), ("",), (" https://orcid.org/0000-1 ",)], "value string")
    assert [r["orcid"] for r in records.orcid_ids(lines).collect()] == ["0000-1"]


def test_dblp_polymorphic_fields(spark):
    one = {"key": "k", "title": "T.", "year": "2020", "venue": ["A", "B"], "authors": {"author": {"@pid": "1", "text": "Ann 0001"}}}
    two = {"key": "l", "title": {"text": "U"}, "year": "2019", "authors": {"author": [{"@pid": "1", "text": "Ann"}, {"@pid": "2", "text": "Bob"}]}}
    raw = spark.createDataFrame([(json.dumps(one),), (json.dumps(two),)], "info string")
    got = {r["source_record_id"]: r for r in records.dblp_hits(raw).collect()}
    assert got["k"]["title"] == "T" and got["k"]["venue"] == "A, B" and got["k"]["authors"][0]["display_name"] == "Ann"
    assert got["l"]["title"] == "U" and len(got["l"]["authors"]) == 2
    assert records.dblp_hits(raw, 2020).count() == 1


def test_openreview_both_versions(spark):
    first = spark.read.json(spark.sparkContext.parallelize([json.dumps({"id": "n1", "cdate": 1700000000000, "content": {"title": "T", "authors": ["A"], "authorids": ["~A"]}})]))
    second = spark.read.json(spark.sparkContext.parallelize([json.dumps({"id": "n1", "cdate": 1700000000000, "content": {"title": {"value": "T"}, "authors": {"value": ["A"]}, "pdf": {"value": "/pdf/1"}}})]))
    for raw in (first, second):
        row = records.openreview_notes(raw).first()
        assert row["title"] == "T" and row["publication_year"] == 2023 and row["authors"][0]["display_name"] == "A"
    assert records.openreview_notes(second).first()["pdf_url"] == "https://openreview.net/pdf/1"


def test_opencitations_and_router(spark):
    raw = spark.createDataFrame([("omid:br/1 doi:10.1/X pmid:7", "omid:br/2")], "cited string, citing string")
    row = records.opencitations_edges(raw).first()
    assert (row["doi"], row["pmid"], row["omid"]) == ("10.1/X", "7", "br/1")
    assert [records.conference_source(v) for v in ("ICLR", "CVPR", "ICML", "ACL", "SIGMOD")] == ["openreview", "cvf", "pmlr", "acl", "dblp"]
    assert records.conference_source("x", collection_id="v139") == "pmlr" and records.conference_source("x", "acl") == "acl"


def test_paged_source(spark, tmp_path):
    from paperloom.sources import paged

    for name, pages in {"a": [["1", "2"], ["3"]], "b": [["4"]]}.items():
        (tmp_path / name).mkdir()
        for n, ids in enumerate(pages):
            cursor = f"c{n + 1}" if n + 1 < len(pages) else None
            (tmp_path / name / ("first.json" if n == 0 else f"c{n}.json")).write_text(json.dumps({"results": [{"id": i, "title": f"t{i}"} for i in ids], "meta": {"next_cursor": cursor}}))
    paged.register(spark)
    read = spark.read.format("paged_json").schema("title string, id string").option("path", str(tmp_path)).load()
    assert sorted(r["id"] for r in read.collect()) == ["1", "2", "3", "4"]
    assert [r["title"] for r in read.where("id = '3'").collect()] == ["t3"]
    assert len(list(paged.follow(lambda c, n: {"results": [{}] * n, "meta": {"next_cursor": "x"}}, 450))) == 450


def test_retries():
    import io
    import urllib.error

    from paperloom.sources import paged

    calls, pauses = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return io.BytesIO(b'{"ok": 1}')

    assert paged.get_json("http://x", {"a": 1}, opener=opener, sleep=pauses.append) == {"ok": 1}
    assert calls[0] == "http://x?a=1" and pauses == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        paged.get_json("http://x", opener=lambda r, timeout: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", {}, None)), sleep=pauses.append)


def test_model_answers():
    from paperloom.plans import requests

    assert requests.parse_keywords('text ["a", "b", "a"] end') == ["a", "b"]
    assert requests.parse_keywords("- deep nets\n2. spin\n\n") == ["deep nets", "spin"]
    assert requests.parse_criteria('{"criteria": [{"name": "x", "weight": 3}, {"name": "y", "weight": 1}, {"name": "z", "weight": 0}]}') == [{"name": "x", "weight": 0.75}, {"name": "y", "weight": 0.25}]
    assert requests.parse_criteria("none") == [] and requests.category("Datasets") == "data" and requests.category(None) == "other"


def test_figures(spark):
    from paperloom.sources import figures

    made = figures.spec(spark.createDataFrame([(2000, 3)], "year int, n int"), "bar", "Papers", "year", "n")
    assert json.loads(figures.dumps(made))["rows"] == [{"year": 2000, "n": 3}]
    with pytest.raises(ValueError, match="kind"):
        figures.spec(spark.range(1), "pie", "t", "id", "id")


def test_conference_index_fields(spark):
    from paperloom.sources import html_links, records

    values = [(1, '["", "https://a", "https://b"]'), (2, '{"#text": "https://c", "url": "x"}'), (3, " https://d "), (4, '[{"text": ""}, {"url": "https://e"}]'), (5, "[]"), (6, ""), (7, None)]
    df = spark.createDataFrame(values, "id int, ee string").select("id", records.first_url(F.col("ee")).alias("u"))
    assert {r["id"]: r["u"] for r in df.collect()} == {1: "https://a", 2: "https://c", 3: "https://d", 4: "https://e", 5: None, 6: None, 7: None}
    assert records.dblp_query("nips", 2020, "deep nets") == "deep nets venue:NeurIPS: year:2020:" and records.dblp_query("xyz", 1999) == "venue:XYZ: year:1999:"
    links = spark.createDataFrame([(1, 0, "/2023.acl-long/", "old"), (1, 1, "/2024.ACL-long/", "new"), (1, 2, "/2024.acl-short/", "new"), (2, 0, "/2024-emnlp", "x"), (2, 1, None, "x")], "page_id int, pos int, href string, link_text string")
    assert [tuple(r) for r in html_links.acl_proceedings(links, "acl", 2024).collect()] == [(1, "/2024.ACL-long/")]


def test_service_rows_and_batches(spark):
    from paperloom.sources import records

    papers = spark.createDataFrame([(7, 2001)], "cited_by_count int, publication_year int")
    assert records.with_aliases(papers).first().asDict() == {"cited_by_count": 7, "publication_year": 2001, "citation_count": 7, "year": 2001}
    raw = spark.createDataFrame([("p1", {"CorpusId": "9", "DOI": "10.1/x"}, "T", 1999, 4, [("Ann",)]), ("p2", {}, None, None, None, None)], "paperId string, externalIds map<string,string>, title string, year int, citationCount int, authors array<struct<name: string>>")
    raw = raw.withColumn("externalIds", F.struct(F.element_at("externalIds", "CorpusId").alias("CorpusId"), F.element_at("externalIds", "DOI").alias("DOI")))
    one, two = records.s2_as_openalex(raw).orderBy("id").collect()
    assert (one["id"], one["doi"], one["cited_by_count"], one["authors"][0]["display_name"], one["source"]) == ("9", "10.1/x", 4, "Ann", "semantic_scholar")
    assert (two["id"], two["corpus_id"], two["title"], two["citation_count"], two["authors"]) == ("p2", "", "", 0, [])
    answers = spark.createDataFrame([("a", 0, "5"), ("a", 1, "6"), ("b", 0, "x")], "request string, pos int, count string")
    assert {r["request"]: r["count"] for r in records.opencitations_count(answers).collect()} == {"a": 5, "b": None}
    batches = records.id_batches(spark.createDataFrame([(f"d{n:02}",) for n in range(25)] + [("",), (None,)], "id string").coalesce(1), 10).collect()
    assert sorted(b["n"] for b in batches) == [5, 10, 10] and sorted(i for b in batches for i in b["ids"].split("__")) == [f"d{n:02}" for n in range(25)]


def test_providers_and_tables(spark):
    from paperloom.sources import datasets, paged

    asked = []
    service = paged.provider("service", "http://s/", "t")
    pages = service.fetch("/works", {"q": 1}, lambda url, params, headers: asked.append((url, params, headers)) or {"results": [{"id": 1}], "meta": {}})
    assert list(paged.follow(pages, 5)) == [{"id": 1}] and asked == [("http://s/works", {"q": 1, "cursor": "*", "per_page": 5}, {"Authorization": "Bearer t"})]
    assert paged.provider().name == "openalex"
    for bad in ("none", "service"):
        with pytest.raises(ValueError):
            paged.provider(bad)
    assert [r.asDict() for r in datasets.as_table(spark, [{"a": 1}, {"a": 2, "b": "x", "c": None}]).orderBy("a").collect()] == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": "x", "c": None}]
    assert datasets.as_table(spark, {"a": 1}).first()["a"] == 1 and datasets.as_table(spark, 3).first()["value"] == 3 and datasets.as_table(spark, []).count() == 0


def test_works_with_raw_authorships_and_concepts(spark):
    from paperloom.model.tables import Tables

    line = {"id": "https://openalex.org/W1", "title": "t", "publication_year": 2000, "cited_by_count": 1, "type": "article", "is_oa": True, "doi": None, "abstract": "a", "source": {"id": "S1", "name": "V", "type": "journal"}, "referenced_works": ["W2"], "concepts": [{"id": "https://openalex.org/C1", "display_name": "Spin", "score": 0.5}],
            "authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": "Ann", "orcid": None}, "author_position": "first", "is_corresponding": True, "institutions": [{"id": "I1", "display_name": "Uni", "country_code": "DE", "type": "education"}]}]}
    more = dict(line, id="W9", topics=[{"id": "T1", "name": "Magnets", "score": 1.0}], concepts=None, authorships=None)
    kind = "id string, title string, publication_year int, cited_by_count int, type string, is_oa boolean, doi string, abstract string, source struct<id: string, name: string, type: string>, referenced_works array<string>, concepts array<struct<id: string, display_name: string, score: double>>, topics array<struct<id: string, name: string, score: double>>, authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, author_position: string, is_corresponding: boolean, institutions: array<struct<id: string, display_name: string, country_code: string, type: string>>>>"
    raw = spark.createDataFrame([(json.dumps(line),), (json.dumps(more),)], "j string").select(F.from_json("j", kind).alias("w")).select("w.*")
    t = Tables.from_works(raw)
    assert {(r["work_id"], r["topic_id"], r["topic"]) for r in t.topics.collect()} == {("W1", "C1", "Spin"), ("W9", "T1", "Magnets")}
    assert [(r["work_id"], r["apos"], r["author_id"], r["is_corresponding"]) for r in t.authorships.collect()] == [("W1", 1, "A1", True)]
    assert [(r["institution_id"], r["country_code"]) for r in t.institutions.collect()] == [("I1", "DE")]
