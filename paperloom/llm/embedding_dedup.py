"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors become one class first. The classes' unit vectors are turned to principal axes (a rotation, so cosines stay),
and sorted into tiles along the leading axes. Every pair of super-tiles is a task. Inside it, pairs of tiles are compared
leading dimensions first: the partial product plus the product of the suffix norms bounds the cosine, and where no pair of
two tiles can reach the threshold the rest is not computed; a bound from the tiles' boxes on the leading axes skips most
pairs of tiles before any product. What may reach it is finished in double precision; pairs within 1e-9 of the threshold
are settled on the given numbers.

A task returns a count of links for each vector and the edges of a spanning forest, never the pairs, so a large group of
near copies costs no more rows than its size. Vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths aren't compared with each other (they stand in groups of their own). Rows with the
same id count as different vectors of one node; a row with a null id links with nothing and isn't kept.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Workspace, arrow_map, components

#: Most and least rows of a super-tile (at least ``SLABS`` of them are made, so that their pairs spread over tasks), rows of
#: a tile, leading dimensions of the first pass.
SUPER, SUPER_LEAST, SLABS, TILE, LEAD = 8192, 1024, 16, 256, 16
#: Cosines this near the threshold are settled on the given numbers; the most that moves a vector along the first axis.
_NEAR, JITTER = 1e-9, 1e-9


def given_vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of numbers, in double precision; huge or tiny ones scaled, so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    given = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    if len(given):
        top = np.abs(given).max(1, keepdims=True)
        given /= np.where((top > 1e100) | (top < 1e-100), top, 1.0)
    return given


def rotation(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors; each task sends one ``dim`` x ``dim`` sum, added up in Spark."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for part in parts:
            x = given_vectors(part.column(0), dim)
            x /= np.sqrt((x**2).sum(1))[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["i", "s"])

    rows = classes.select("v").mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    matrix = np.zeros(dim * dim)
    for r in rows:
        matrix[r["i"]] = r["s"]
    values, axes = np.linalg.eigh(matrix.reshape(dim, dim))
    return axes[:, np.argsort(-values)]


class Forest:
    """Union-find over the rows of one comparison."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.parent[rows]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[rows] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.roots(a), self.roots(b)
        open_ = ra != rb
        if not open_.any():
            return
        _, pick = np.unique(np.minimum(ra, rb)[open_] * len(self.parent) + np.maximum(ra, rb)[open_], return_index=True)
        for i, j in zip(a[open_][pick].tolist(), b[open_][pick].tolist(), strict=True):
            x, y = int(self.roots(np.array([i]))[0]), int(self.roots(np.array([j]))[0])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((i, j))


def compare(a: np.ndarray, b: np.ndarray | None, given_a: np.ndarray, given_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, lead: int = LEAD, tile: int = TILE):
    """Links within ``a`` (``b`` is None) or between ``a`` and ``b``: weighted counts for each row and forest edges."""
    same = b is None
    if same:
        b, given_b, weight_b = a, given_a, weight_a
    na, nb = len(a), len(b)
    lead = min(lead, a.shape[1])
    counts_a, counts_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    forest = Forest(na + (0 if same else nb))
    shift = 0 if same else na
    rest_a, rest_b = (np.sqrt(np.maximum(0, (x[:, lead:] ** 2).sum(1))) for x in (a, b))
    head_a, head_b = np.ascontiguousarray(a[:, :lead]), np.ascontiguousarray(b[:, :lead])
    tiles_a, tiles_b = range(0, na, tile), range(0, nb, tile)
    low_a, high_a = (np.stack([f(head_a[s : s + tile], 0) for s in tiles_a]) for f in (np.min, np.max))
    low_b, high_b = (np.stack([f(head_b[s : s + tile], 0) for s in tiles_b]) for f in (np.min, np.max))
    most_a, most_b = (np.array([r[s : s + tile].max() for s in ts]) for r, ts in ((rest_a, tiles_a), (rest_b, tiles_b)))
    slack = threshold - 1e-7
    for i, s in enumerate(tiles_a):
        # The largest product on the leading axes that the tiles' boxes allow, plus that of the suffix norms.
        corners = np.maximum(np.maximum(low_a[i] * low_b, low_a[i] * high_b), np.maximum(high_a[i] * low_b, high_a[i] * high_b)).sum(1)
        near = np.flatnonzero(corners + most_a[i] * most_b >= slack)
        x, rx = head_a[s : s + tile], rest_a[s : s + tile]
        for j in near.tolist():
            if same and j < i:
                continue
            t = j * tile
            bound = x @ head_b[t : t + tile].T
            cosine = bound.copy() if lead == a.shape[1] else None
            bound += np.multiply.outer(rx, rest_b[t : t + tile])
            p, q = np.nonzero(bound >= slack)
            if same and j == i:
                keep = p < q
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            if cosine is not None:
                values = cosine[p, q]
            elif len(p) * 4 > bound.size:
                values = (a[s : s + tile] @ b[t : t + tile].T)[p, q]
            else:
                values = np.einsum("ij,ij->i", a[s + p], b[t + q])
            p, q = p + s, q + t
            close = np.flatnonzero(np.abs(values - threshold) <= _NEAR)
            if len(close):
                u, v = given_a[p[close]], given_b[q[close]]
                values[close] = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
            linked = values >= threshold
            p, q = p[linked], q[linked]
            if not len(p):
                continue
            counts_a += np.bincount(p, weight_b[q], na).astype(np.int64)
            other = counts_a if same else counts_b
            other += np.bincount(q, weight_a[p], nb).astype(np.int64)
            forest.link(p, q + shift)
    return counts_a, counts_b, forest.edges


def kd_order(x: np.ndarray, tile: int) -> np.ndarray:
    """An order in which runs of ``tile`` rows lie close together: halves along the widest axis, again and again."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= tile:
            out.append(rows)
            continue
        axis = int(x[rows].var(0).argmax())
        half = -(-(len(rows) // 2) // tile) * tile
        rows = rows[np.argpartition(x[rows, axis], half)]
        stack += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.arange(0)


def _super_pairs(cuts: list[float], threshold: float) -> list[list[int]]:
    """For each slab of the first axis the slabs (itself and later ones) that can hold vectors within the threshold."""
    n = len(cuts) + 1
    edges = np.array([-1.0, *cuts, 1.0])
    # Angles to the axis of vectors that the jitter put into a slab.
    high, low = np.arccos(np.clip(edges[:-1] - 2 * JITTER, -1, 1)), np.arccos(np.clip(edges[1:] + 2 * JITTER, -1, 1))
    reach = np.arccos(min(1.0, threshold)) + 1e-6
    return [[j for j in range(i, n) if low[i] - high[j] <= reach and low[j] - high[i] <= reach] for i in range(n)]


def _compared(space: Workspace, classes: DataFrame, dim: int, n: int, threshold: float, super_rows: int | None) -> DataFrame:
    """Counts (``key``, ``n``) and forest edges (``u``, ``v``) among classes of one length."""
    axes = rotation(classes, dim)
    slabs = -(-n // (super_rows or min(SUPER, max(SUPER_LEAST, -(-n // SLABS)))))
    kind = dict(classes.dtypes)["v"]

    def along():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            key, rep, n, v, jitter = batch.columns
            given = given_vectors(v, dim)
            yield {"key": key, "rep": rep, "n": n, "given": v, "y": given @ axes[:, 0] / np.sqrt((given**2).sum(1)) + jitter.to_numpy()}

        return work

    # The jitter spreads vectors that are equal on the axis. The vectors travel as they were given; single precision takes
    # half the room.
    jittered = classes.withColumn("jitter", F.xxhash64("key") * F.lit(JITTER / 2**63))
    placed = space.write(arrow_map(jittered, ["key", "rep", "n", "v", "jitter"], f"key string, rep bigint, n bigint, given {kind}, y double", along), "placed")
    cuts = sorted(set(placed.approxQuantile("y", [k / slabs for k in range(1, slabs)], 0.2 / slabs))) if slabs > 1 else []
    partners = _super_pairs(cuts, threshold)
    pairs = [(i, j) for i, others in enumerate(partners) for j in others]
    of_slab: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(pairs):
        of_slab.setdefault(i, []).append(k)
        if j != i:
            of_slab.setdefault(j, []).append(k)
    side = {k: p for k, p in enumerate(pairs)}

    def deal():
        def place(batch: pa.RecordBatch) -> Iterator[dict]:
            key, rep, n, v, y = batch.columns
            slab = np.searchsorted(cuts, y.to_numpy(), "right")
            yield {"key": key, "rep": rep, "n": n, "v": v, "slab": slab, "pair": [of_slab[x] for x in slab.tolist()]}

        return place

    dealt = arrow_map(placed, ["key", "rep", "n", "given", "y"], f"key string, rep bigint, n bigint, v {kind}, slab int, pair array<int>", deal).withColumn("pair", F.explode("pair"))

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = side[group["pair"][0].as_py()]
        given = given_vectors(group["v"], dim)
        turned = (given @ axes) / np.sqrt((given**2).sum(1))[:, None]
        rep, weight, slab = (group[c].to_numpy() for c in ("rep", "n", "slab"))
        sides = []
        for own in dict.fromkeys((i, j)):
            rows = np.flatnonzero(slab == own)
            sides.append(rows[kd_order(turned[rows, :LEAD], TILE)])
        a, b = sides[0], sides[-1]
        hit, counts, ends = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64)
        if len(a) and len(b):
            counts_a, counts_b, edges = compare(turned[a], None if i == j else turned[b], given[a], given[b], weight[a], weight[b], threshold)
            order = a if i == j else np.concatenate([a, b])
            counts = counts_a if i == j else np.concatenate([counts_a, counts_b])
            hit, ends = order[counts > 0], order[np.array(edges, np.int64).reshape(-1, 2)]
            counts = counts[counts > 0]
        none = lambda n, kind: pa.nulls(n, kind)
        key = group["key"].combine_chunks().take(pa.array(hit)).cast(pa.string())
        links = pa.table({"key": key, "n": pa.array(counts, pa.int64()), "u": none(len(hit), pa.int64()), "v": none(len(hit), pa.int64())})
        forest = pa.table({"key": none(len(ends), pa.string()), "n": none(len(ends), pa.int64()), "u": pa.array(rep[ends[:, 0]], pa.int64()), "v": pa.array(rep[ends[:, 1]], pa.int64())})
        return pa.concat_tables([links, forest])

    return dealt.groupBy("pair").applyInArrow(work, "key string, n bigint, u bigint, v bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", super_rows: int | None = None) -> DataFrame:
    """For each row: the id, ``n_links``, ``component_id``, ``kept`` (the id is the component's smallest)."""
    space = Workspace(vectors.sparkSession, "embeddings")
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    # Zeros lose their sign, so equal vectors have equal digests; the smallest id stands for a class.
    digest = F.md5(F.to_json(F.struct(F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("v"))))
    keyed = rows.where(good).withColumn("key", digest)
    classes = space.write(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")
    results = space.spark.createDataFrame([], "key string, n bigint, u bigint, v bigint")
    for dim, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        results = results.unionByName(_compared(space, classes.where(F.size("v") == dim), dim, n, threshold, super_rows))
    found = space.write(results, "found")
    links = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("linked"))
    reached = components(space, found.where("key is null").select("u", "v"))
    about = classes.select("key", "rep", "n").join(links, "key", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("key", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    about = space.write(about, "about")
    out = rows.select("id", F.when(good, digest).alias("key")).join(about, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
