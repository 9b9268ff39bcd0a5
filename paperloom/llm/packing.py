"""Order-preserving packing of token streams by dynamic programming.

A task reads its documents in order as one stream of tokens, each document followed by an end id. Cuts may fall after a
document (free), after a sentence (``SENTENCE``), or every ``STEP`` tokens inside one (``INSIDE``, the truncation penalty).
With ``best(j)`` the least cost of a stream cut at position ``p(j)``::

    best(j) = penalty(j) + min over i with p(j) - p(i) <= size of best(i) + size - (p(j) - p(i))

The minimum of ``best(i) + p(i)`` over a sliding window is kept in a monotone queue, so each candidate costs O(1) amortised.
The stream is handled in blocks whose last window is carried on, which bounds memory by a block and the longest document's
ids. The end of a task's stream is split into powers of two, which need no padding.

Nulls and empty texts are documents of the end id alone. Ids may repeat or be null; each row is packed by itself. Extra
columns are ignored. Nothing is shuffled: sequences never span tasks, and their ids hold the task's number.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paperloom.llm.common import text_bytes
from paperloom.llm.tokens import ODD, safe_chunks

SENTENCE, INSIDE, STEP = 1, 12, 16
#: Tokens of a stream that are cut at once.
BLOCK = 1 << 18


class Encoder:
    """Ids of a byte-level BPE file as ``tokenizers`` gives them, by the faster of two libraries where their classes agree."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        self.odd = regex.compile(ODD).search
        self.ends = np.zeros(max([*ranks.values(), *specials.values()]) + 1, bool)
        for s, i in ranks.items():
            self.ends[i] = s.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in s

    def ids(self, text: str) -> np.ndarray:
        if self.odd(text):
            parts = [np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint32) for x in safe_chunks(text)]
        else:
            parts = [self.fast.encode_to_numpy(x, allowed_special="all") for x in safe_chunks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def candidates(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document's ids may be cut, and the penalty of each place; the last is the document's end."""
    n = len(ids)
    cost = np.zeros(n + 1, np.uint8)
    cost[STEP::STEP] = 1 + INSIDE
    cost[np.flatnonzero(ends[ids]) + 1] = 1 + SENTENCE
    cost[n] = 1
    at = np.flatnonzero(cost)
    return at, cost[at] - 1


def cut(places: list[int], penalties: list[int], size: int, last: bool) -> list[int]:
    """Indices of the chosen cuts, from 0 (the stream's start) to the end or, unless ``last``, to the best place near it."""
    keys, back, queue = [0], [0], deque([0])
    for j in range(1, len(places)):
        low = places[j] - size
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        key = keys[i] + size + penalties[j]  # best(j) + p(j)
        back.append(i)
        keys.append(key)
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = len(places) - 1
    if not last:
        j = min((i for i in range(j, 0, -1) if places[i] > places[-1] - size), key=lambda i: keys[i] - places[i], default=j)
    chosen = [j]
    while j:
        chosen.append(j := back[j])
    return chosen[::-1]


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """One task's stream."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id = size, first_id
        self.docs: list[list] = []  # [id, where it starts in the buffer (may be negative), its tokens]
        self.parts: list[np.ndarray] = []
        self.places, self.penalties = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)]
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray, at: np.ndarray, cost: np.ndarray) -> None:
        self.docs.append([doc_id, self.held, len(ids)])
        self.parts.append(ids)
        self.places.append(at + self.held)
        self.penalties.append(cost)
        self.held += len(ids)

    def flush(self, last: bool) -> dict[str, list]:
        """Pack what is held; unless ``last``, the end of the stream stays for the next block."""
        out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        if not self.held:
            return out
        ids, places, penalties = (np.concatenate(x) for x in (self.parts, self.places, self.penalties))
        chosen = places[cut(places.tolist(), penalties.tolist(), self.size, last)]
        if last and (left := int(chosen[-1] - chosen[-2])) < self.size:
            chosen = np.concatenate([chosen[:-1], chosen[-2] + np.cumsum(powers(left))])
        end = int(chosen[-1])
        starts = np.array([d[1] for d in self.docs], np.int64)
        edges = np.unique(np.concatenate([chosen, np.clip(starts, 0, end)]))
        doc = np.searchsorted(starts, edges[:-1], "right") - 1
        sequence = np.searchsorted(chosen, edges[:-1], "right") - 1
        raw = np.ascontiguousarray(ids, "<u4")
        bounds = edges.tolist()
        for k, (d, q) in enumerate(zip(doc.tolist(), sequence.tolist(), strict=True)):
            a, b = bounds[k], bounds[k + 1]
            own = self.docs[d]
            for name, value in zip(out, (own[0], a - own[1], b - a, zlib.crc32(raw[a:b]), own[2], self.next_id + q, a - int(chosen[q])), strict=True):
                out[name].append(value)
        self.next_id += len(chosen) - 1
        keep = [d for d in self.docs if d[1] + d[2] > end]
        self.docs = [[d[0], d[1] - end, d[2]] for d in keep]
        after = places > end
        self.parts = [ids[end:]]
        self.places, self.penalties = [np.zeros(1, np.int64), places[after] - end], [np.zeros(1, np.uint8), penalties[after]]
        self.held -= end
        return out


def pack(documents: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    kind = dict(documents.select(id_col).dtypes)[id_col]
    target = pa.schema([(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in target.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        packer = Packer(size, TaskContext.get().partitionId() << 36)
        id_type = None

        def rows(last: bool) -> pa.RecordBatch:
            out = packer.flush(last)
            return pa.RecordBatch.from_arrays([pa.array(out["doc"], id_type), *[pa.array(out[n], pa.int64()) for n in target.names]], [id_col, *target.names])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids = np.append(encoder.ids(raw.decode()), np.uint32(end_id)).astype(np.uint32)
                packer.add(doc_id, ids, *candidates(ids, encoder.ends))
                if packer.held >= BLOCK:
                    yield rows(False)
        if id_type is not None:
            yield rows(True)

    return documents.select(id_col, text_col).mapInArrow(run, schema)
