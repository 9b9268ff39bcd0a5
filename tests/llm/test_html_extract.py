import pytest

from paperloom.llm import html_extract as H

PAGE = "<html><head><title>T</title><style>x</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now</div>{}<footer>&copy; me</footer></body></html>"
LONG = "A sentence with many plain words in it, as articles have them. " * 4


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Title &amp; more</h1><p>One\n  two<b>three</b>.<p>Four<br>five</article>", "Title & more\nOne twothree.\nFour five"),
        (f"<article><h1>T</h1><p>{LONG}</p><aside>Side</aside><form><p>Search</p></form><div class='comments'><p>Nice {LONG}</p></div></article>", f"T\n{LONG.strip()}"),
        (f"<main><div><p>{LONG}</p><div id='cookie-notice'>Accept</div><ul><li>x</li></ul></div></main>", f"{LONG.strip()}\nx"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
        ("", ""),
        (f"<article><p>{LONG}", LONG.strip()),
    ],
)
def test_extract(body, text):
    page = PAGE.format(body) if not body.endswith(LONG) or "</" in body else body
    assert H.extract(page) == text


@pytest.mark.parametrize("name", ["layout has-sidebar", "container with-ads", "sidebar page", "widget"])
def test_a_container_with_a_barred_word(name):
    body = f"<div class='{name}'><article><h1>T</h1><p>{LONG}</p></article><div class='sidebar'><p>Side {LONG}</p></div></div>"
    assert H.extract(PAGE.format(body)) == f"T\n{LONG.strip()}"
    body = f"<div class='{name}'><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>Side</p></div></div>"
    assert LONG.strip() in H.extract(PAGE.format(body)) and "Side" not in H.extract(PAGE.format(body))


def test_comments_stay_out_however_long():
    remarks = "".join(f"<article class='comment'><p>Nice {LONG}</p></article><article><p>Me too {LONG}</p></article>" for _ in range(9))
    for body in (f"<article><p>{LONG}</p></article><div id='comments'>{remarks}</div>", f"<div><p>{LONG}</p><p>{LONG}</p></div><section class='comments'>{remarks}</section>"):
        text = H.extract(PAGE.format(body))
        assert LONG.strip() in text and "Nice" not in text and "Me too" not in text


def pages_without_marks(rng):
    """Pages of plain ``div`` elements, with their main text: menus, teasers and footers have no telling names."""
    sentence = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(rng.choice([8, 14, 25]))) + "."
    for _ in range(60):
        blocks = [" ".join(sentence() for _ in range(rng.choice([1, 2, 5]))) for _ in range(rng.choice([4, 8, 15]))]
        if rng.random() < 0.5:
            blocks.insert(2, f"Heading {rng.randrange(99)}")
        links = lambda n: "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(n))
        html = f"<html><body><div class='top'>{links(rng.choice([6, 12]))}</div><div class='c'>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</div><div>{links(rng.choice([5, 20]))}</div><div><span>Imprint</span> <span>2024</span></div></body></html>"
        yield html, "\n".join(blocks)


def test_density_finds_text_without_marks(make):
    """Share of words right (F1): with the density threshold, and without it."""

    def score(got, want):
        got, want = got.split(), want.split()
        common = sum(min(got.count(w), want.count(w)) for w in set(want))
        return 2 * common / (len(got) + len(want))

    pages = list(pages_without_marks(make.rng))
    with_, without = (sum(score(H.extract(h, density=d), t) for h, t in pages) / len(pages) for d in (True, False))
    assert with_ >= 0.97 and without <= 0.93 and sum(H.extract(h) == t for h, t in pages) >= 0.6 * len(pages), (with_, without)


def test_a_menu_inside_the_article():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(12)) + "</ul>"
    text = H.extract(PAGE.format(f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p><a href=/x>One link</a></p><p>{LONG}</p>{menu}</article>"))
    assert text.startswith("T\n") and "One link" in text and "story 7" not in text and text.count(LONG.strip()) == 3


def test_open_elements_and_stray_ends_are_cheap():
    import time

    start = time.process_time()
    H.extract("<b>" * 100_000 + "<i>" + "</u>" * 100_000 + f"<article><p>{LONG}" + "</b>" * 50_000 + "<td></td>" * 50_000)
    H.extract("<div class='ad'>x" * 20_000)
    assert time.process_time() - start < 20


def test_pages_of_the_fixture(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>" * 3000, "x"), (2, "u", "plain text only", "x")], "page_id long, url string, html string, text string")
    got = H.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", "plain text only"]
    assert H.extract_pages(pages.limit(0)).count() == 0
