import numpy as np
import pytest

from paperloom.llm import near_duplicates as N


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets}


def corpus(make):
    rng, rows = make.rng, []
    for n in range(40):
        base = make(rng.choice([1, 4, 5, 9, 40, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = make(1)[0]
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "ONE"), (905, "É é"), (906, rows[3][1].upper()), (None, rows[0][1])]


@pytest.mark.parametrize("options", [{}, {"group_limit": 3}])
def test_matches_brute_force(spark, make, options):
    rows = corpus(make)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def test_a_chain_of_copies_and_repeated_rows(spark, make):
    words = make(200, 10**6)
    rows = []
    for n in range(30):
        rows.append((n, " ".join(words)))
        words[n * 6] = f"new{n}"
    rows += [rows[7]] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
        truth = 800 / 1200
        errors.append(float(N.estimate(N.registers(np.unique(a)), N.registers(np.unique(b))[None])[0]) - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
