from paperloom.llm import queries, url_filter

URLS = [
    (1, "http://Example.NET/en/x?q#f"), (2, "https://a.b.example.com/de/"), (3, "https://example.com/de"), (4, "ftp://net"), (5, "x://net/"), (6, None), (7, ""), (8, "no scheme"), (9, "http://xnet.org/fr/1"), (10, "http://org/fr/"), (11, "a://b://c.net/z"),
    (12, "http://host.net:80/"), (1, "http://Example.NET/en/x?q#f"), (None, "http://q.net/a"), (13, "http://ÄÉ.NET/İ"), (14, "http://" + "a." * 500 + "net/" + "p" * 5000),
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check(spark, **options):
    rules = spark.createDataFrame(queries.RULES, "rule_host string, rule_path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, rules, **options).collect()), key=repr)
    assert got == sorted(((i, *brute(u)) for i, u in URLS), key=repr)


def test_contract_rules(spark):
    check(spark)


def test_list_too_long_to_broadcast(spark):
    check(spark, broadcast_rules=0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, none).first()["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_many_rules_match_an_exact_lookup(spark):
    listed = {f"h{i}.com" for i in range(0, 3000, 2)}
    rules = spark.createDataFrame([(h, "/", "block") for h in listed], "rule_host string, rule_path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x") for i in range(3000)], "page_id long, url string")
    got = {r["page_id"] for r in url_filter.filter_urls(pages, rules).where("verdict = 'block'").collect()}
    assert got == set(range(0, 3000, 2))
