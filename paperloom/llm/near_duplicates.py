"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct five-word shingles (A-Z lower-cased; with fewer words the whole sequence is
one). Equal sets are one class first, so exact copies cost one row each. A class has ``M`` registers: an element's hash picks
a register, which keeps the least hash it saw as its count of leading zeros and ten mantissa bits (16 bits in all); registers
that saw nothing borrow along a fixed random order. Four registers make a band, 64 bits; classes that share one of the 32
bands are candidates (a pair at Jaccard 0.75 is missed with probability 5e-6).

Candidates are never listed as pairs. Each band's classes are tied to the least of them, and the connected parts of these
ties are the candidate groups; a part of over ``GROUP`` classes is taken apart into its bands' buckets again. A group is cut
into tiles by hash, every pair of tiles is one task, and the task compares its classes row by row: first by the estimate from
registers, corrected for chance collisions, then on the full sets. It returns a spanning forest of the links it found, so
what is made grows with the classes, not with their pairs. Components of those links are the result.

Links need ``100 * intersection >= 75 * union``. Nulls, empty texts and texts without words have no set and link with
nothing; a null id links with nothing and has no component, and such rows are kept. Rows with the same id and text are both
kept if that id is. Extra columns are ignored. Sets are of 64-bit hashes, and a class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Workspace, arrow_map, components, possibly_in, text_bytes
from paperloom.llm.decontaminate import MEMORY, gram_hashes

WIDTH, M, BAND, MANTISSA = 5, 128, 4, 10
#: Classes and shingles of a tile; classes of a group that is compared as a whole.
TILE, TILE_SHINGLES, GROUP = 128, 1 << 19, 1 << 15
#: Chance that two different elements give one register value: equal leading zeros (1/3) and equal mantissas.
COLLISION = 1 / (3 << MANTISSA)
#: Standard deviations below the threshold at which an estimate still goes to verification.
MARGIN = 5.0
#: For each register the order in which it borrows.
_DONORS = np.random.default_rng(20240229).permuted(np.tile(np.arange(M), (M, 1)), axis=1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = raw.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(gram_hashes(own, min(WIDTH, max(1, len(own)))))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def registers(own: np.ndarray) -> np.ndarray:
    """``M`` compressed registers of a set that isn't empty."""
    x = np.sort(_mixed(own))  # the first of each register's run is its least
    at, first = np.unique(x >> np.uint64(57), return_index=True)
    rest = x[first] << np.uint64(7) | np.uint64(1)
    zeros = np.uint64(64) - np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(63))
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    values, seen = np.zeros(M, np.uint16), np.zeros(M, bool)
    values[at.astype(np.int64)] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    seen[at.astype(np.int64)] = True
    if len(at) < M:
        empty = np.flatnonzero(~seen)
        donors = _DONORS[empty]
        values[empty] = values[donors[np.arange(len(empty)), seen[donors].argmax(1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = values.reshape(len(values), -1, BAND).astype(np.uint64)
    keys = parts[..., 0]
    for i in range(1, BAND):
        keys = keys << np.uint64(16) | parts[..., i]
    return _mixed(keys ^ _mixed(np.arange(1, keys.shape[1] + 1, dtype=np.uint64))).view(np.int64)


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for collisions."""
    return ((others == one).mean(1) - COLLISION) / (1 - COLLISION)


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether two sorted sets have ``100 * intersection >= share * union``."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= share * (len(a) + len(b) - common)


def compare(sets: list[np.ndarray], split: int, share: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the sets (``split`` 0), or between the first ``split`` and the others."""
    sizes = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    least = share / 100 - MARGIN * np.sqrt(share / 100 * (1 - share / 100) / M)
    parent = np.arange(len(sets))
    edges = []
    for i in range(split or len(sets) - 1):
        rest = np.arange(split or i + 1, len(sets))
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(100 * small >= share * large) & (parent[rest] != parent[i])]
        if len(rest):
            # Small sets have too few elements for the estimate's error; they are cheap to verify.
            rest = rest[(np.minimum(sizes[rest], sizes[i]) < 2 * M) | (estimate(regs[i], regs[rest]) >= least)]
        for j in rest.tolist():
            if parent[i] != parent[j] and linked(sets[i], sets[j], share):
                edges.append((i, j))
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
    return edges


def near_duplicates(documents: DataFrame, share: int = 75, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP) -> DataFrame:
    """For each row: the id, ``n_shingles``, ``component_id`` (the smallest id reachable), ``kept`` (it is the row's own)."""
    space = Workspace(documents.sparkSession, "near")
    source = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def sketch():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict = {"id": batch.column(0), "node": [], "n": [], "regs": []}
            for raw, known in zip(text_bytes(batch.column(1)), batch.column(0).is_valid().to_pylist(), strict=True):
                own = shingle_set(raw, hashes)
                has = known and len(own) > 0
                out["node"].append(node_of(own) if has else None)
                out["n"].append(len(own))
                out["regs"].append(registers(own).tobytes() if has else None)
            yield out

        return work

    rows = space.write(arrow_map(source, ["id", "text"], "id bigint, node bigint, n bigint, regs binary", sketch), "rows")
    classes = space.write(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")

    def banded():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            if len(batch):
                keys = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), M))
                yield {"band": keys.ravel(), "node": np.repeat(batch.column(0).to_numpy(), keys.shape[1])}

        return work

    banding = arrow_map(classes, ["node", "regs"], "band bigint, node bigint", banded)
    leaders = space.write(banding.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "leader"), "leaders")
    ties = banding.join(leaders, "band").where("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    groups = space.write(components(space, ties), "groups").withColumnRenamed("component", "gid")

    # Groups that are too large to compare as a whole fall back to the buckets that tied them.
    large = space.write(groups.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_limit).select("gid"), "large")
    if large.limit(1).count():
        inside = groups.join(large, "gid", "left_semi").select("node")
        buckets = banding.join(leaders.select("band"), "band").join(inside, "node", "left_semi").select("node", F.col("band").alias("gid"))
        groups = space.write(groups.join(large, "gid", "left_anti").select("node", "gid").unionByName(buckets), "regrouped")

    members = space.write(groups.join(classes.select("node", "rep", "n"), "node"), "members")
    weights = members.groupBy("gid").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(F.col("s") / TILE_SHINGLES), F.lit(1)).cast("int")
    tiled = space.write(weights.select("gid", tiles.alias("tiles")), "tiles")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    dealt = members.join(tiled, "gid").withColumn("tile", own).select("gid", "node", "tile", F.explode(pairs).alias("p")).select("gid", "node", "tile", "p.i", "p.j")

    def full():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            sets = [shingle_set(raw, hashes) for raw in text_bytes(batch.column(1))]
            yield {"node": [node_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return work

    wanted = possibly_in(source.where("id is not null"), "id", members.select("rep").distinct(), "rep")
    sets = arrow_map(wanted, ["id", "text"], "node bigint, shingles binary", full).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = space.write(sets, "sets")

    def settle(group: pa.Table) -> pa.Table:
        order = np.argsort(group["tile"].to_numpy(), kind="stable")
        tile, node = group["tile"].to_numpy()[order], group["node"].to_numpy()[order]
        held = group["shingles"].to_pylist()
        raw = [np.frombuffer(held[k], np.uint64) for k in order.tolist()]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        split = int((tile == i).sum()) if i != j else 0
        ends = np.array(compare(raw, split, share) if i == j or 0 < split < len(raw) else [], np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(node[ends[:, 0]], pa.int64()), "v": pa.array(node[ends[:, 1]], pa.int64())})

    links = dealt.join(sets, "node").groupBy("gid", "i", "j").applyInArrow(settle, "u bigint, v bigint")
    reached = space.write(components(space, space.write(links, "links")), "reached")
    least = reached.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = space.write(reached.join(least, "component").select("node", "least"), "found")
    about = space.write(classes.select("node", "rep").join(found, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id")), "about")
    out = rows.select("id", "node", "n").join(about, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
