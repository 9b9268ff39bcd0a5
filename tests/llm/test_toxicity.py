import itertools
import zlib

import numpy as np

from paperloom.llm import toxicity as X


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    chain = X.Chain(np.array([-0.7, 0.3, 0.9]))
    lengths = np.array([5, 1, 0, 7])
    emission = rng.normal(size=13)
    got, at = chain.marginals(emission, lengths), 0
    for n in lengths:
        e = emission[at : at + n]
        total, toxic = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            score, before = 0.0, 0
            for t, s in enumerate(states):
                score += (e[t] if s else 0) + {(0, 1): -0.7, (1, 0): 0.3, (1, 1): 0.9, (0, 0): 0.0}[before, s]
                before = s
            total += np.exp(score)
            toxic += np.exp(score) * np.array(states)
        assert np.allclose(got[at : at + n], toxic / total if n else [])
        at += n


def test_long_chains_match_one_segment_after_another():
    rng = np.random.default_rng(4)
    chain, e = X.Chain(np.array([-1.0, -0.5, 0.8])), rng.normal(size=1000) * 3
    odds, forward = 0.0, []
    for x in e:
        odds = (chain.b + odds * chain.c) * np.exp(x) / (1 + odds * chain.d)
        forward.append(odds)
    back, backward = 1.0, [0.0] * 1000
    for t in range(999, -1, -1):
        backward[t] = back
        w = np.exp(e[t]) * back
        back = (chain.d + chain.c * w) / (1 + chain.b * w)
    both = np.array(forward) * np.array(backward)
    assert np.allclose(chain.marginals(e, np.array([1000])), both / (1 + both))


def corpus(make, n=400):
    rng, bad = make.rng, ["vile", "rotten", "awful"]
    docs = []
    for i in range(n):
        words = make(rng.choice([20, 60, 200]))
        y = i % 4 == 0
        for _ in range(rng.choice([1, 3]) if y else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), int(y)))
    return docs


def test_held_out_accuracy(spark, make):
    rows = corpus(make)
    docs = spark.createDataFrame([(i, t, y) for i, t, y in rows] + [(9000, None, 0), (9001, "", 0), (None, "vile", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.7) == y for i, y in held]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.3 and len(got[None]["spans"]) == 1
    toxic = next(i for i, _, y in rows if y)
    text = rows[toxic][1]
    assert {text[s["start"] : s["end"]] for s in got[toxic]["spans"]} <= {"vile", "rotten", "awful"}


def test_labels_that_may_not_be_learned_change_nothing(spark, make):
    rows = corpus(make, 120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in X.toxicity(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_no_or_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in X.toxicity(docs, none).collect()} == {0.5}
    assert X.toxicity(docs.limit(0), none).count() == 0
