import hashlib
import re

from paperloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(docs, items, span=13):
    windows = {}
    for i, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = WORD.findall(ascii_lower(t or ""))
        hit, found = [False] * len(w), set()
        for n, known in windows.items():
            for a in range(len(w) - n + 1):
                if s := known.get(tuple(w[a : a + n])):
                    found |= s
                    hit[a : a + n] = [True] * n
        ids = sorted(found)
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def data(make):
    bench = [make(40) for _ in range(12)] + [make(13), make(12), make(3), make(1), ["same"] * 30]
    items = [(n, " ".join(b)) for n, b in enumerate(bench)] + [(90, None), (91, "!!"), (3, " ".join(bench[0]))]
    docs = []
    for n in range(60):
        own = make(make.rng.choice([0, 5, 30, 300]))
        if n % 3 == 0:
            b = make.rng.choice(bench)
            a = make.rng.randrange(len(b))
            at = make.rng.randrange(len(own) + 1)
            own[at:at] = b[a : a + make.rng.choice([5, 12, 13, 14, 40])]
        docs.append((n, make.rng.choice([" ", ", ", "-"]).join(own).replace("w1", "W1")))
    return docs + [(None, None), (3, docs[3][1]), (100, ""), (101, "same " * 50), (102, "É" * 3 + " " + items[0][1])], items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, spans int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, items string")
    return sorted((tuple(r) for r in D.contract(D.decontaminate(d, b, **options)).collect()), key=repr)


def test_matches_brute_force(spark, make):
    docs, items = data(make)
    assert run(spark, docs, items) == brute(docs, items)


def test_slices_give_the_same(spark, make):
    docs, items = data(make)
    assert run(spark, docs, items, broadcast_words=200) == brute(docs, items)


def test_empty_tables(spark, make):
    docs, items = data(make)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_keeps_columns(spark):
    d = spark.createDataFrame([("t", 5, None)], "text string, doc_id long, extra int")
    b = spark.createDataFrame([(1, "t")], "item_id long, text string")
    assert D.decontaminate(d, b, keep=d.columns, prefix="_x").columns == ["text", "doc_id", "extra", "_xn_words", "_xn_hit", "_xitems", "_xspans"]
