"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans are the leftmost matches of four patterns with their checks. The field then labels every token that holds a
digit or an at sign (all others can only be clean). Neighbouring tokens share chain potentials; tokens of a document that
are the same or have the same shape share skip potentials with their next occurrence, however distant. Base tokens are
evidence; loopy belief propagation carries their labels along both kinds of edges, so that one entity is labelled alike
throughout a document. Runs of tokens whose marginal reaches ``SURE`` become further spans, cut to what their kind can be: a
card's digits must pass Luhn, an ip's parts be at most 255, a phone number have 9 to 15 digits. Base spans always stay.

The weights are trained by pseudo-likelihood on the base labels of the ``SAMPLE`` documents of least hash (of id and text)
among a share of those that hold a digit or an at sign and have at most ``SAMPLE_CHARS`` characters, so they don't depend on
how rows are dealt. Matches that a check refused are clean there, unless a number that would pass lies inside them: those
tokens count as unknown.

Nulls and empty texts have no spans. Each row is judged by itself and whole; repeated rows and null ids come back as they
are; extra columns are ignored. Work grows in proportion to the text, and memory with the tokens that hold a digit or an at
sign (a few hundred bytes each, in flat arrays). Offsets count code points.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, text_bytes

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, SURE = 4000, 20_000, 0.9
#: Weights of hashed features; tokens that go through belief propagation at once; its rounds.
WEIGHTS, GROUP, ROUNDS = 1 << 12, 50_000, 15
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9][0-9.]*").finditer
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search
_MARK = re.compile(r"[0-9@]\S*")
_SPACE = re.compile(r"\s")
_PUNCTUATION = ".,;:!?()[]{}<>\"'|"
_MAILBOX = re.compile(r"[^\s@<>()\[\]{},;:\"'|]+@[^\s@<>()\[\]{},;:\"'|]*[^\W_]").finditer
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])").finditer
_DIALLED = re.compile(r"(?:\+|\(\+?)?[0-9][\x20().0-9-]*[0-9]").finditer
_GROUPS = re.compile(r"[0-9]+").finditer
#: Edges whose messages are made at once.
EDGES = 1 << 13


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind's number, end) in order, and likewise the matches that failed a check."""
    found, failed = [], []
    at, last = text.find("@"), 0
    while at != -1:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            end = last = m.end()
            found.append((start, 0, end))
        at = text.find("@", end)
    if not _DIGIT(text):
        return sorted(found), failed
    if "." in text:
        for run in _DOTTED(text):
            if run.group().count(".") >= 3:
                for m in _IP(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        found.append((m.start(), 1, m.end()))
                    else:
                        failed.append((m.start(), 1, m.end()))
    for m in _CARD(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
            else:
                failed.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
            else:
                failed.append((m.start(), 3, m.end()))
    return sorted(found), failed


def cards_within(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of digits, one space or hyphen apart, with 12 to 19 digits that pass Luhn: leftmost, then longest."""
    groups = [m.span() for m in _GROUPS(text, start, end)]
    i = 0
    while i < len(groups):
        digits, best = "", -1
        for j in range(i, min(len(groups), i + 19)):
            if j > i and (groups[j][0] - groups[j - 1][1] != 1 or text[groups[j][0] - 1] not in " -"):
                break
            if len(digits) + groups[j][1] - groups[j][0] > 19:
                break
            digits += text[groups[j][0] : groups[j][1]]
            if len(digits) >= 12 and luhn(digits):
                best = j
        if best >= 0:
            yield groups[i][0], groups[best][1]
            i = best
        i += 1


def refine(text: str, kind: int, start: int, end: int) -> list[tuple[int, int]]:
    """What in a run of tokens that the field gives to a kind can be of that kind."""
    if kind == 0:
        return [m.span() for m in _MAILBOX(text, start, end)]
    if kind == 1:
        return [m.span() for m in _QUAD(text, start, end) if all(int(p) <= 255 for p in m.group().split("."))]
    if kind == 2:
        return list(cards_within(text, start, end))
    out = []
    for m in _DIALLED(text, start, end):
        digits, stop = 0, -1
        for g in _GROUPS(text, m.start(), m.end()):
            digits += g.end() - g.start()
            if digits > 15:
                break
            if digits >= 9:
                stop = g.end()
        if stop >= 0:
            out.append((m.start(), stop))
    return out


class Cover:
    """Whether a range meets one of many spans, by one search."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.ends, most = [], [], 0
        for start, _, end in spans:  # in order of their starts
            most = max(most, end)
            self.starts.append(start)
            self.ends.append(most)

    def meets(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.ends[n - 1] > start


def candidates(text: str) -> list[tuple[int, int]]:
    """Ranges of the tokens between white space that hold a digit or an at sign."""
    out, last = [], 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = m.end()
        out.append((start, last))
    return out


def shape(token: str) -> str:
    token = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"\d", "9", token)[:40]


def _word(text: str, start: int, step: int) -> str:
    piece = text[max(0, start - 40) : start] if step < 0 else text[start : start + 40]
    words = piece.split()
    return (words[-1] if step < 0 else words[0]).lower() if words else ""


class Graph:
    """Candidate tokens of many documents with their chain and skip edges, in flat arrays."""

    def __init__(self) -> None:
        self.features = array("i")
        self.label = array("b")  # 0 clean, 1 to 4 the kinds, -1 unknown
        self.where = array("q")  # number of the document, start, end
        # Pairs of tokens: neighbours; a token and the next that is the same; a token and the next of the same shape. In each
        # of the three a token has one edge to an earlier token at most, and one to a later.
        self.chain = array("i")
        self.skip = array("i")
        self.alike = array("i")

    def add(self, number: int, text: str, spans: list[tuple[int, int, int]], failed: list[tuple[int, int, int]], train: bool) -> None:
        tokens = candidates(text)
        starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
        labels = array("b", [0 if train else -1]) * len(tokens)

        def mark(ranges: list[tuple[int, int, int]], label: int | None) -> None:
            for a, kind, b in ranges:
                i = bisect_right(ends, a)
                while i < len(tokens) and starts[i] < b:
                    if labels[i] <= 0:
                        labels[i] = kind + 1 if label is None else label
                    i += 1

        if train:
            mark([x for x in failed if x[1] == 3 and sum(map(str.isdigit, text[x[0] : x[2]])) > 15 or x[1] == 2 and any(cards_within(text, x[0], x[2]))], -1)
        mark(spans, None)
        last_of: dict[str, int] = {}
        before, before_end, before_shape = -1, -2, ""
        shapes = [shape(text[s:e]) for s, e in tokens]
        for n, (s, e) in enumerate(tokens):
            token, own = text[s:e], len(self.label)
            self.label.append(labels[n])
            self.where.extend((number, s, e))
            near = s - before_end == 1 and before >= 0
            core = token.strip(_PUNCTUATION)
            names = [f"s{shapes[n]}", f"c{shape(core)}", f"d{min(20, sum(map(str.isdigit, token)))}", f"@{'@' in token}", f".{token.count('.')}", f"+{token[:1]}", f"l{len(token) // 4}",
                     f"p{before_shape if near else _word(text, s, -1)}", f"n{shapes[n + 1] if n + 1 < len(tokens) and tokens[n + 1][0] - e == 1 else ''}"]
            self.features.extend(zlib.crc32(f.encode()) % WEIGHTS for f in names)
            if near:
                self.chain.extend((before, own))
            for key, edges in ((f"={core.lower()}", self.skip), (f"~{shape(core)}", self.alike)):
                if key in last_of:
                    edges.extend((last_of[key], own))
                last_of[key] = own
            before, before_end, before_shape = own, e, shapes[n]


class Model:
    def __init__(self) -> None:
        n = len(KINDS) + 1
        self.weights, self.chain = np.zeros((WEIGHTS, n)), np.zeros((n, n))
        self.skip = np.eye(n)  # the prior: repeated tokens are labelled alike

    def emission(self, graph: Graph) -> np.ndarray:
        features = np.array(graph.features, np.int32).reshape(len(graph.label), -1)
        out = np.zeros((len(features), self.weights.shape[1]))
        for column in features.T:
            out += self.weights[column]
        return out

    def fit(self, graph: Graph, steps: int = 200) -> "Model":
        """Pseudo-likelihood: each token given its features and the labels around it."""
        y = np.array(graph.label, np.int64)
        if not len(y):
            return self
        n = len(KINDS) + 1
        features = np.array(graph.features, np.int64).reshape(len(y), -1)
        chain, skip, alike = (np.array(x, np.int64).reshape(-1, 2) for x in (graph.chain, graph.skip, graph.alike))
        skip = np.concatenate([skip, alike])
        chain, skip = (x[(y[x] >= 0).all(1)] for x in (chain, skip))
        known = np.flatnonzero(y >= 0)
        one = np.eye(n)[np.maximum(y, 0)]
        before, after, around = np.zeros((len(y), n)), np.zeros((len(y), n)), np.zeros((len(y), n))
        np.add.at(before, chain[:, 1], one[chain[:, 0]])
        np.add.at(after, chain[:, 0], one[chain[:, 1]])
        np.add.at(around, skip[:, 1], one[skip[:, 0]])
        np.add.at(around, skip[:, 0], one[skip[:, 1]])
        square = [np.full_like(x, 1e-3) for x in (self.weights, self.chain, self.skip)]
        for _ in range(steps):
            score = self.weights[features].sum(1) + before @ self.chain + after @ self.chain.T + around @ self.skip
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            off = np.zeros_like(p)
            off[known] = (p - one)[known] / len(known)
            g = np.zeros_like(self.weights)
            for c in range(features.shape[1]):
                np.add.at(g, features[:, c], off)
            s = around.T @ off
            for x, grad, sq in zip((self.weights, self.chain, self.skip), (g + 1e-6 * self.weights, before.T @ off + (after.T @ off).T + 1e-4 * self.chain, (s + s.T) / 2 + 1e-4 * (self.skip - np.eye(n))), square, strict=True):
                sq += grad * grad
                x -= 0.2 * grad / np.sqrt(sq)
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product with damping; labelled tokens are clamped."""
        n, size = len(KINDS) + 1, len(graph.label)
        unary = self.emission(graph)
        y = np.array(graph.label, np.int64)
        fixed = np.flatnonzero(y > 0)
        unary[fixed] = -60.0
        unary[fixed, y[fixed]] = 0.0
        unary = unary.T.astype(np.float32)
        # Both directions along each family of edges: sources, targets, factor, messages (a column for each edge).
        families = []
        for edges, factor in ((graph.chain, self.chain), (graph.skip, self.skip), (graph.alike, self.skip)):
            pairs = np.array(edges, np.int32).reshape(-1, 2)
            there, back = pairs[:, 0].copy(), pairs[:, 1].copy()
            grown = np.exp(factor).astype(np.float32)
            families.append([(there, back, grown.T, np.zeros((n, len(pairs)), np.float32)), (back, there, grown, np.zeros((n, len(pairs)), np.float32))])
        for _ in range(ROUNDS):
            belief, moved = self._belief(unary, families), 0.0
            for ways in families:
                for at in range(0, len(ways[0][0]), EDGES):
                    part = slice(at, at + EDGES)
                    old = [way[3][:, part].copy() for way in ways]
                    for (source, _, factor, message), own, other in zip(ways, old, old[::-1], strict=True):
                        out = belief[:, source[part]] - other
                        np.exp(out - out.max(0), out=out)
                        new = np.log(factor @ out + np.float32(1e-30))
                        new -= new.max(0)
                        moved = max(moved, float(np.abs(new - own).max()))
                        message[:, part] = 0.5 * own + 0.5 * new
            if moved < 1e-3:
                break
        belief = self._belief(unary, families).T.astype(float)
        p = np.exp(belief - belief.max(1, keepdims=True)) if size else belief
        return p / p.sum(1, keepdims=True) if size else p

    @staticmethod
    def _belief(unary: np.ndarray, families: list) -> np.ndarray:
        belief = unary.copy()
        for ways in families:
            for _, target, _, message in ways:
                belief[:, target] += message  # a token is the target of one edge of a family in one direction at most
        return belief


def find(model: Model, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, as (start, kind's number, end)."""
    out: list = []
    graph = Graph()
    waiting: dict[int, tuple[str, Cover]] = {}

    def settle() -> None:
        nonlocal graph
        p = model.marginals(graph)
        best = p[:, 1:].argmax(1) + 1
        sure = (np.array(graph.label) <= 0) & (p[np.arange(len(p)), best] >= SURE)
        where = np.array(graph.where).reshape(-1, 3)
        runs: list[list[int]] = []
        for i in np.flatnonzero(sure).tolist():
            number, s, e = where[i].tolist()
            kind = int(best[i]) - 1
            if runs and runs[-1][:2] == [number, kind] and runs[-1][3] == s - 1:
                runs[-1][3] = e  # the parts of one number
            else:
                runs.append([number, kind, s, e])
        for number, kind, s, e in runs:
            text, cover = waiting[number]
            out[number][1].extend((a, kind, b) for a, b in refine(text, kind, s, e) if not cover.meets(a, b))
        graph = Graph()
        waiting.clear()

    for number, text in enumerate(texts):
        spans, failed = base_spans(text)
        out.append((spans, list(spans)))
        if _DIGIT(text) or "@" in text:
            cover = Cover(spans)
            if not all(cover.meets(s, e) for s, e in candidates(text)):
                graph.add(number, text, spans, failed, False)
                waiting[number] = text, cover
        if len(graph.label) >= GROUP:
            settle()
    if waiting:
        settle()
    return [(base, sorted(set(spans))) for base, spans in out]


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    """Fit on the base labels of a bounded sample of documents that hold candidates."""
    rows = documents.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    # A share of the ids, by hash, so that no task has to hand its own best rows to the driver; few texts hold candidates.
    share = min(1.0, 20 * most / max(1, documents.count()))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    fit = drawn.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).withColumn("t", F.xxhash64("text"))
    # Only hashes are put in order; the texts up to the last of them are the sample, repeated rows once.
    last = fit.select("h", "t").distinct().orderBy("h", "t").limit(most).agg(F.max(F.struct("h", "t")).alias("last")).first()["last"]
    graph = Graph()
    if last is not None:
        chosen = fit.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("t") <= last["t"]))
        texts = {(r["h"], r["t"]): r["text"] for r in chosen.dropDuplicates(["h", "t"]).collect()}
        for n, key in enumerate(sorted(texts)):
            graph.add(n, texts[key], *base_spans(texts[key]), True)
    return Model().fit(graph)


def find_pii(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """For each row the id, ``base`` and ``spans`` (arrays of start, end, kind). With ``redact`` the columns ``keep``, among them
    the text with every span replaced by its kind in brackets, come instead."""
    model = model or train(documents, id_col, text_col)
    kinds = dict(documents.dtypes)
    others = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c != text_col]
    columns = [*others, text_col]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            column = batch.column(len(columns) - 1)
            texts = [raw.decode() for raw in text_bytes(column)]
            found = find(model, texts)
            out = {c: batch.column(columns.index(c)) for c in others}
            if redact:
                new = [None if not ok else _redacted(t, spans) for t, (_, spans), ok in zip(texts, found, column.is_valid().to_pylist(), strict=True)]
                yield out | {text_col: new}
            else:
                rows = lambda which: [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in x[which]] for x in found]
                yield {id_col: out[id_col], "base": rows(0), "spans": rows(1)}

        return work

    if redact:
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    else:
        spans = "array<struct<start: bigint, end: bigint, kind: string>>"
        schema = f"`{id_col}` {kinds[id_col]}, base {spans}, spans {spans}"
    return arrow_map(documents, columns, schema, make)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        elif e > at:
            parts.append(text[at:s])
        at = max(at, e)
    return "".join([*parts, text[at:]])


def contract(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the registered query."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
