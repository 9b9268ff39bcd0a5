import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import packing, tokens
from paperloom.llm.queries import tokenizer_path

TEXTS = ["", None, "Hello  world\n\n it's <|endoftext|> fine<|endoftext|>", " " * 60 + "x", "naïve café — “quoted” … €5 ½", "日本語のテキスト と emoji 🙂", "a" * 5000, "word " * 30000, "\u0558\u058b odd \u209f", "tab\tand\u00a0nbsp\u2003em", "the the the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_classes_agree_outside_the_odd_ranges(library):
    counter, encoder = tokens.Counter(tokenizer_path()), packing.Encoder(tokenizer_path())
    odd = regex.compile(tokens.ODD)
    for c in map(chr, range(1, 0x3000)):
        if not odd.search(c):
            s = f"a{c}1{c}! {c}"
            assert counter.count(s) == len(ids(library, s)) and encoder.ids(s).tolist() == ids(library, s), hex(ord(c))


def test_whole_tokens_encode_as_themselves(library):
    counter = tokens.Counter(tokenizer_path())
    assert len(counter.whole) > 40_000
    assert all(len(ids(library, w)) == 1 for w in counter.whole[::977])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_counts_and_ids_are_the_library_s(library, text):
    counter, encoder = test_counts_and_ids_are_the_library_s.made
    assert counter.count(text) == len(ids(library, text))
    assert encoder.ids(text).tolist() == ids(library, text)


test_counts_and_ids_are_the_library_s.made = (tokens.Counter(tokenizer_path()), packing.Encoder(tokenizer_path()))


def test_safe_chunks_join_to_the_text(library):
    text = "One two  three\n four's five " * 2000
    parts = list(tokens.safe_chunks(text, 1000))
    assert "".join(parts) == text and len(parts) > 10
    assert sum(len(ids(library, p)) for p in parts) == len(ids(library, text))


def test_token_query(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 2)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, tokenizer_path()).collect()}
    for i, t in enumerate(TEXTS):
        n = len(ids(library, t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert got[None]["n_tokens"] == len(ids(library, "null id"))
    assert tokens.count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "n"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append([*ids(library, t), 0])
    used = defaultdict(list)
    for p in pieces:
        assert 1 <= p["length"] <= 1024
        assert any(zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4")) == p["ids_crc32"] and len(x) == p["doc_tokens"] for x in whole[p["doc_id"]])
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in whole.values() for x in xs)
    padding = 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(p["length"] for p in pieces)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 12)), min_size=1, max_size=40))
def test_cuts_are_the_best(steps):
    """The monotone queue finds the cost that plain quadratic dynamic programming finds."""
    places, penalties = [0], [0]
    for gap, cost in steps:
        places.append(places[-1] + gap)
        penalties.append(cost)
    size, best = 32, [0]
    for j in range(1, len(places)):
        best.append(min(best[i] + size - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= size) + penalties[j])
    chosen = packing.cut(places, penalties, size, True)
    cost = sum(size - (places[b] - places[a]) + penalties[b] for a, b in zip(chosen, chosen[1:], strict=False))
    assert chosen[0] == 0 and chosen[-1] == len(places) - 1 and cost == best[-1]


def test_a_stream_longer_than_a_block(library):
    encoder, packer = packing.Encoder(tokenizer_path()), packing.Packer(64, 0)
    text = "Some sentence here. Another one, somewhat longer than that! " * 3
    sizes = defaultdict(int)
    for n in range(200):
        own = np.append(encoder.ids(text), np.uint32(0)).astype(np.uint32)
        packer.add(n, own, *packing.candidates(own, encoder.ends))
        if packer.held > 500:
            out = packer.flush(False)
            for q, m in zip(out["sequence_id"], out["length"], strict=True):
                sizes[q] += m
    out = packer.flush(True)
    for q, m in zip(out["sequence_id"], out["length"], strict=True):
        sizes[q] += m
    assert sum(sizes.values()) == 200 * len(own) and max(sizes.values()) <= 64
