"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Every ``K`` consecutive words make a k-gram hash,
and of each ``SPAN - K + 1`` consecutive k-grams the least ones are fingerprints. Two texts that share
``SPAN`` words in a row share all k-grams of that run, hence a fingerprint: no shared run of ``SPAN`` words is missed.
Test fingerprints are joined with each document's, and every hit is extended word by word to both sides; a run that
reaches ``SPAN`` words marks its words. Items with fewer words than ``SPAN`` are matched whole, by hashes of their length.

Word hashes have 64 bits; no text is compared by more than those. Each row of documents is judged by itself: nulls and
texts without words have no hits; repeated rows and null ids come back as they are. Items without words match nothing;
items with the same id count once. Extra columns are ignored.

A test set of up to ``BROADCAST_WORDS`` words goes to every task, so documents aren't shuffled at all. A larger one is
cut into slices of at most that size by a shuffle of the items; documents then meet each slice in turn and the parts are
joined by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Workspace, arrow_map, text_bytes

SPAN, K = 13, 5
#: Most benchmark words that a task holds at once (about 30 bytes a word).
BROADCAST_WORDS = 4_000_000
#: Distinct words whose hashes a task remembers.
MEMORY = 500_000
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word to 64-bit hash; forgets when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, raw: bytes) -> np.ndarray:
        words = _WORDS(raw.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_MIX[0])
        out ^= out >> np.uint64(29)
        out += words[i : i + n]
    out *= np.uint64(_MIX[1])
    return out ^ (out >> np.uint64(31))


def _slide(extreme: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """The extreme of each ``window`` consecutive values, by doubling."""
    n, have = len(values) - window + 1, 1
    while have * 2 <= window:
        values = extreme(values[:-have], values[have:])
        have *= 2
    return extreme(values[:n], values[window - have : window - have + n])


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some ``window`` consecutive ones (of all, if there are fewer); ties all stay."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    least = _slide(np.minimum, hashes, window)
    # A position holds the least hash of a window just if the largest of its windows' minima is its own hash.
    around = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(_slide(np.maximum, around, window) == hashes)


class TestSet:
    """Fingerprints of benchmark items and the words around them, with separators that match nothing."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, k: int = K) -> None:
        self.span, self.k = span, min(k, span)
        self.ids = sorted({str(i) for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        hashes, words, item, prints, places = WordHashes(), [], [], [], []
        short: dict[int, dict[int, set[int]]] = {}
        at = 0
        for item_id, raw in sorted({(str(i), b) for i, b in items}):
            own = hashes.of(raw)
            if 0 < len(own) < span:
                short.setdefault(len(own), {}).setdefault(int(gram_hashes(own, len(own))[0]), set()).add(number[item_id])
            elif len(own):
                grams = gram_hashes(own, self.k)
                chosen = winnow(grams, span - self.k + 1)
                prints.append(grams[chosen])
                places.append(chosen + at)
                words.append(own)
                item.append(np.full(len(own), number[item_id]))
                at += len(own)
        empty = np.empty(0, np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.item = np.concatenate(item) if item else empty
        prints_, places_ = (np.concatenate(prints), np.concatenate(places)) if prints else (np.empty(0, np.uint64), empty)
        order = np.argsort(prints_, kind="stable")
        self.prints, self.places = prints_[order], places_[order]
        self.short = {n: (np.array(sorted(x), np.uint64), [sorted(x[h]) for h in sorted(x)]) for n, x in short.items()}

    def _extend(self, own: np.ndarray, at: np.ndarray, there: np.ndarray, covered: np.ndarray, found: set[int]) -> None:
        """Extend hits at ``own[at]`` = ``words[there]`` to both sides; mark runs of ``span`` words."""
        reach = self.span - self.k
        item = self.item[there]
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side, step, first in ((left, -1, -1), (right, 1, 0)):
            going = np.ones(len(at), bool)
            for i in range(first, (reach + self.k) * step + first, step):
                a, b = at + i, there + i
                inside = going & (a >= 0) & (a < len(own)) & (b >= 0) & (b < len(self.words))
                going = inside.copy()
                ai, bi = a[inside], b[inside]
                going[inside] = (own[ai] == self.words[bi]) & (self.item[bi] == item[inside])
                if not going.any():
                    break
                side += going
        good = left + right >= self.span
        for a, lo, hi in zip(at[good].tolist(), left[good].tolist(), right[good].tolist(), strict=True):
            covered[a - lo] += 1
            covered[a + hi] -= 1
        found.update(np.unique(item[good]).tolist())

    def judge(self, own: np.ndarray) -> tuple[int, np.ndarray, set[int]]:
        """Words, the mask of hit words, and numbers of the items found, for a document's word hashes."""
        covered = np.zeros(len(own) + 1, np.int64)
        found: set[int] = set()
        if len(self.prints) and len(own) >= self.span:
            grams = gram_hashes(own, self.k)
            at = winnow(grams, self.span - self.k + 1)
            low = np.searchsorted(self.prints, grams[at], "left")
            count = np.searchsorted(self.prints, grams[at], "right") - low
            hit = np.flatnonzero(count)
            ends = np.cumsum(count[hit])
            a = 0
            while a < len(hit):  # a bounded number of pairs at once
                base = ends[a] - count[hit[a]]
                b = max(a + 1, int(np.searchsorted(ends, base + 200_000, "right")))
                part = hit[a:b]
                times = count[part]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                self._extend(own, np.repeat(at[part], times), self.places[np.repeat(low[part], times) + offset], covered, found)
                a = b
        for n, (known, items) in self.short.items():
            grams = gram_hashes(own, n)
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == grams).tolist():
                covered[p] += 1
                covered[p + n] -= 1
                found.update(items[at[p]])
        return len(own), np.cumsum(covered[:-1]) > 0, found



_FOUND = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<start: bigint, end: bigint>>"}


def _judged(documents: DataFrame, tests: TestSet, carried: list[str], text_col: str, prefix: str = "") -> DataFrame:
    kinds = dict(documents.dtypes)
    columns = list(dict.fromkeys([*carried, text_col]))

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict = {n: [] for n in _FOUND}
            for raw in text_bytes(batch.column(columns.index(text_col))):
                n, mask, found = tests.judge(hashes.of(raw))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                out["n_words"].append(n)
                out["n_hit"].append(int(mask.sum()))
                out["items"].append([tests.ids[i] for i in sorted(found)])
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            yield {c: batch.column(columns.index(c)) for c in carried} | {f"{prefix}{n}": x for n, x in out.items()}

        return work

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"`{prefix}{n}` {kind}" for n, kind in _FOUND.items())])
    return arrow_map(documents, columns, schema, make)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, broadcast_words: int = BROADCAST_WORDS, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """For each row: the id (or the columns ``keep``), and with ``prefix`` before their names ``n_words``, ``n_hit``, ``items``
    (sorted ids found), and ``spans`` (word ranges that are hit)."""
    carried = keep or [id_col]
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null and id is not null")
    size = F.length(F.regexp_replace(F.lower("text"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "x"))  # at least the words
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= broadcast_words:
        tests = TestSet([(r["id"], r["text"].encode()) for r in items.toLocalIterator()], span, k)
        return _judged(documents, tests, carried, text_col, prefix)

    # Too large for one task: slices of items, each judged over all documents, united for each row of documents.
    space = Workspace(documents.sparkSession, "decontaminate")
    # Row numbers hold only once they are written.
    keyed = space.write(documents.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"), F.struct(*carried).alias("_own")), "documents")
    slices = -(-int(total) // broadcast_words) * 2
    sliced = space.write(items.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")), "items")
    parts = None
    for n in range(slices):
        tests = TestSet([(r["id"], r["text"].encode()) for r in sliced.where(F.col("slice") == n).toLocalIterator()], span, k)
        part = space.write(_judged(keyed, tests, ["_row"], "_text"), f"slice{n}")
        parts = part if parts is None else parts.unionByName(part)
    united = parts.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    merged = F.aggregate(
        "all",
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    united = united.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))
    joined = keyed.select("_row", "_own").join(united, "_row")
    return joined.select(*[F.col(f"_own.{c}").alias(c) for c in carried], *[F.col(n).alias(f"{prefix}{n}") for n in _FOUND])


def contaminated(prefix: str = "") -> Column:
    """Whether a judged row counts as contaminated: at least a twentieth of its words are hit."""
    hit = F.col(f"{prefix}n_hit")
    return (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words"))


def contract(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the registered query."""
    ids = F.array_join("items", ",")
    return judged.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))
