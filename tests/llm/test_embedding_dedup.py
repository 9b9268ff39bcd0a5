import numpy as np
import pytest

from paperloom.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u) in enumerate(good):
        for j, v in good[:a]:
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("super_rows", [40, None])
def test_matches_brute_force(spark, super_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(n, (centres[n % 6] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist()) for n in range(160)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, (np.array(rows[3][1], np.float32) * 4).tolist()), (203, [0.0] * 24), (204, None), (205, [float("nan")] + [1.0] * 23), (206, [None] + [1.0] * 23), (207, []), (208, [1.0, 2.0]), (209, [2.0, 4.0]), (210, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, key int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df, super_rows=super_rows).collect()}
    assert got == brute(rows)


def test_threshold_is_exact(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, np.sqrt(1 - 0.81)]), (3, [0.9 - 1e-7, np.sqrt(1 - 0.81)])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df).collect()}
    assert got == {i: n for i, (n, *_) in brute(rows).items()}


def test_a_chain_of_vectors(spark):
    """Each within reach of the next alone; the least id stands at one end, the others fall towards it."""
    vectors, last = [], np.zeros(70)
    last[0] = 1.0
    for n in range(70):
        vectors.append(last.tolist())
        last = last * 0.909
        last[(n + 1) % 70] += np.sqrt(1 - 0.909**2)
        last /= np.linalg.norm(last)
    rows = list(zip([0, *range(69, 0, -1)], vectors, strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()}
    assert got == brute(rows) and {c for _, c, _ in got.values()} == {0}


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["kept"]) for r in E.near_duplicates(df).collect()}
    assert got == {None: (0, False), 1: (0, True)}
    assert E.near_duplicates(df.limit(0)).count() == 0
