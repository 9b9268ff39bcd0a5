"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's emission is a sum of hashed weights (the word, its prefixes, its suffixes), the chain
adds transition scores. Labels exist only for whole documents, so word labels are derived first: in the training sample, a
word of a toxic document is labelled toxic if the word or one of its prefixes occurs (by documents) almost only in toxic
ones, and in too many families of copies for chance. The field is trained on these labelled words by gradient steps on the chain likelihood.

Forward-backward marginals of every word of a whole text give the document's features (largest marginal, sum of marginals),
which a logistic curve turns into the score; words whose marginal passes one half give the offending offsets.

Nulls and texts without words score as clean as the curve's lower end. Each row is scored by itself, so repeated rows and
null ids come back as they are; extra columns are ignored. Long texts are handled in segments of words whose transfer
matrices are chained, so nothing is cut. Training reads about ``SAMPLE`` documents of either label, of at most
``SAMPLE_CHARS`` characters, chosen by a hash of their id; this is the only bounded part. Without labels of both kinds the
score is the share of toxic labels everywhere (one half if there are none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, text_bytes

SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Weights, words of a segment, words of texts that are scored at once, and words whose emission a task remembers.
WEIGHTS, SEGMENT, GROUP, MEMORY = 1 << 18, 32, 1 << 19, 500_000
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"w{w}", *(f"p{w[:n]}" for n in range(3, 9) if len(w) >= n), *(f"s{w[-n:]}" for n in (3, 4) if len(w) >= n)]


def hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % WEIGHTS for f in features(word)]


class Chain:
    """Marginals of the toxic state for many chains at once. ``trans``: scores of clean-toxic, toxic-clean, toxic-toxic."""

    def __init__(self, trans: np.ndarray) -> None:
        self.b, self.d, self.c = np.exp(trans)

    def _layout(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        segments = np.maximum(1, -(-lengths // SEGMENT))
        first = np.cumsum(segments) - segments
        start = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) + np.repeat(first * SEGMENT - start, lengths)
        return segments, first, place

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``emission`` holds the words' scores of all chains, one after the other."""
        return self._run(emission, lengths)[0]

    def _run(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        b, c, d = self.b, self.c, self.d
        segments, first, place = self._layout(lengths)
        total = int(segments.sum())
        flat = np.zeros(total * SEGMENT)
        flat[place] = np.exp(np.clip(emission, -30, 30))
        real = np.zeros(total * SEGMENT, bool)
        real[place] = True
        e, real = np.ascontiguousarray(flat.reshape(total, SEGMENT).T), np.ascontiguousarray(real.reshape(total, SEGMENT).T)
        whole = real.all(1)
        # Transfer matrix of each segment, scaled.
        oo, ot, to, tt = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
        for t in range(SEGMENT):
            n = oo + ot * d, (oo * b + ot * c) * e[t], to + tt * d, (to * b + tt * c) * e[t]
            if not whole[t]:
                n = tuple(np.where(real[t], x, y) for x, y in zip(n, (oo, ot, to, tt), strict=True))
            scale = 1 / np.maximum(np.maximum(n[0], n[1]), np.maximum(n[2], n[3]))
            oo, ot, to, tt = (x * scale for x in n)
        # Chain the segments of each text, all texts at once by the segment's rank.
        fo, ft = np.ones(total), np.zeros(total)  # before the segment; a text starts clean
        bo, bt = np.ones(total), np.ones(total)  # after the segment
        order = np.argsort(-segments, kind="stable")
        counts = segments[order]
        for k in range(1, int(counts[0]) if len(counts) else 0):
            own = first[order[: np.searchsorted(-counts, -k, "left")]] + k
            p = own - 1
            x, y = fo[p] * oo[p] + ft[p] * to[p], fo[p] * ot[p] + ft[p] * tt[p]
            fo[own], ft[own] = x / (x + y), y / (x + y)
        last = first + segments - 1
        for k in range(1, int(counts[0]) if len(counts) else 0):
            own = last[order[: np.searchsorted(-counts, -k, "left")]] - k
            p = own + 1
            x, y = oo[p] * bo[p] + ot[p] * bt[p], to[p] * bo[p] + tt[p] * bt[p]
            bo[own], bt[own] = x / (x + y), y / (x + y)
        # Within segments, as odds.
        forward, backward = np.empty_like(e), np.empty_like(e)
        odds = ft / fo
        for t in range(SEGMENT):
            new = (b + odds * c) * e[t] / (1 + odds * d)
            odds = new if whole[t] else np.where(real[t], new, odds)
            forward[t] = odds
        odds = bt / bo
        for t in range(SEGMENT - 1, -1, -1):
            backward[t] = odds
            with_e = e[t] * odds
            new = (d + c * with_e) / (1 + b * with_e)
            odds = new if whole[t] else np.where(real[t], new, odds)
        both = forward * backward
        pick = lambda x: x.T.reshape(-1)[place]
        return pick(both / (1 + both)), pick(forward), pick(backward)


class Model:
    """Weights, transitions and the curve; emissions of words are remembered per task, not shipped."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, curve: np.ndarray) -> None:
        self.weights, self.bias, self.trans, self.curve = weights, bias, trans, curve

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer(dict):
    """Word to emission, and the scores of texts."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.chain = model, Chain(model.trans)

    def __missing__(self, word: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        self[word] = e = float(self.model.weights[hashed(word)].sum() + self.model.bias)
        return e

    def summaries(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """For each text the curve's inputs, and the offsets of words whose marginal passes one half."""
        words = [_WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        emission = np.fromiter((e for w in words for e in map(self.__getitem__, w)), float, int(lengths.sum()))
        del words
        p = self.chain.marginals(emission, lengths)
        ends = np.cumsum(lengths)
        x, spans = np.zeros((len(texts), 2)), []
        for k, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            own = p[a:b]
            top = float(own.max()) if b > a else 0.0
            x[k] = np.log((top + 1e-5) / (1 - top + 1e-5)), np.log1p(float(own.sum()))
            spans.append([])
            if top > 0.5:
                at = set(np.flatnonzero(own > 0.5).tolist())
                spans[-1] = [m.span() for n, m in enumerate(_WORD.finditer(texts[k])) if n in at]
        return x, spans

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        x, spans = self.summaries(texts)
        return 1 / (1 + np.exp(-(x @ self.model.curve[:2] + self.model.curve[2]))), spans


def family(words: list[str]) -> int:
    """The least hash of a document's word pairs: copies and most near copies have the same one."""
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=0)


def word_labels(docs: list[list[str]], toxic: np.ndarray, purity: float = 0.9, risk: float = 0.05) -> list[np.ndarray]:
    """For each document, which of its words are toxic.

    A word or prefix is evidence if at least ``purity`` of its documents are toxic, in so many families of copies that chance
    would give it to one among all features with probability ``risk`` at most.
    """
    seen, bad, families = Counter(), Counter(), {}
    of: dict[str, list[str]] = {}
    for words, y in zip(docs, toxic, strict=True):
        own = set()
        for w in set(words):
            if w not in of:
                of[w] = [f for f in features(w) if f[0] in "wp"]
            own.update(of[w])
        seen.update(own)
        if y:
            bad.update(own)
            group = family(words)
            for f in own:
                families.setdefault(f, set()).add(group)
    tested = sum(n >= 3 for n in seen.values()) or 1
    least = max(3, int(np.ceil(np.log(risk / tested) / np.log(np.mean(toxic)))))
    evidence = {f for f, n in bad.items() if n >= purity * seen[f] and len(families[f]) >= least}
    wanted = {w for w, fs in of.items() if evidence.intersection(fs)}
    return [np.array([bool(y) and w in wanted for w in words], bool) for words, y in zip(docs, toxic, strict=True)]


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7, epochs: int = 12) -> Model:
    """Train on labelled documents; see the module's text for the word labels."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        share = np.clip(toxic.mean() if len(toxic) else 0.5, 0.01, 0.99)
        return Model(np.zeros(WEIGHTS, np.float32), -8.0, np.zeros(3), np.array([0, 0, np.log(share / (1 - share))]))
    same: dict[str, str] = {}  # one string for each word
    docs = [[same.setdefault(w, w) for w in map(str.lower, _WORD.findall(t))] for t in texts]
    labels = word_labels(docs, toxic)
    rng = np.random.default_rng(seed)
    # Training windows: around labelled words, and others for contrast.
    windows = []
    for words, y in zip(docs, labels, strict=True):
        at = np.flatnonzero(y)[:20]
        others = rng.integers(0, max(1, len(words)), 2)
        for s in {max(0, int(a) // 24 * 24 - 4) for a in [*at, *others]}:
            if words[s : s + 32]:
                windows.append((words[s : s + 32], y[s : s + 32]))
    of = {w: np.array(hashed(w)) for ws, _ in windows for w in ws}
    weights, bias, trans = np.zeros(WEIGHTS), -2.0, np.array([-1.0, 0.0, 0.0])
    square, square_b, square_t = np.full(WEIGHTS, 1e-2), 1e-2, np.full(3, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), 512):
            part = [windows[i] for i in order[a : a + 512]]
            lengths = np.array([len(w) for w, _ in part])
            index = [of[w] for ws, _ in part for w in ws]
            sizes = np.array([len(x) for x in index])
            flat = np.concatenate(index)
            emission = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes) + bias
            y = np.concatenate([z for _, z in part]).astype(float)
            chain = Chain(trans)
            p, forward, backward = chain._run(emission, lengths)
            off = (p - y) / len(part)
            # Expected transitions from the odds before and after each word; a chain starts clean.
            first = np.zeros(len(y), bool)
            first[np.cumsum(lengths) - lengths] = True
            before = np.where(first, 0, np.concatenate([[0], forward[:-1]]))
            e = np.exp(np.clip(emission, -30, 30)) * backward
            pairs = np.stack([chain.b * e, before * chain.d, before * chain.c * e])
            expected = (pairs / (1 + pairs.sum(0))).sum(1)
            y0 = np.where(first, 0, np.concatenate([[0], y[:-1]]))
            observed = np.array([((1 - y0) * y).sum(), (y0 * (1 - y)).sum(), (y0 * y).sum()])
            g = np.bincount(flat, np.repeat(off, sizes), WEIGHTS) + 1e-5 * weights
            square += g * g
            weights -= 0.3 * g / np.sqrt(square)
            gb = off.sum()
            square_b += gb * gb
            bias -= 0.3 * gb / np.sqrt(square_b)
            gt = (expected - observed) / len(part) + 1e-4 * trans
            square_t += gt * gt
            trans = np.clip(trans - 0.3 * gt / np.sqrt(square_t), -8, 8)
    model = Model(weights.astype(np.float32), float(bias), trans, np.zeros(3))
    scorer, x = model.scorer(), []
    for a in range(0, len(texts), 500):
        x.append(scorer.summaries(texts[a : a + 500])[0])
    model.curve = logistic(np.concatenate(x), toxic.astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for two inputs and a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), gradient)
        w -= step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """About ``most`` labelled documents of either label (a hash draws them; fewer where there are fewer) whose crc32(id) mod 3 isn't 1, by a hash of the id."""
    learn = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    learn = learn.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    # A share of each label by a hash of the id: tasks hand on what they draw, not each their own best rows.
    share = {r["y"]: min(1.0, most / r["n"]) for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    test = F.lit(False)
    for y, part in sorted(share.items()):
        test = test | ((F.col("y") == y) & (place < int(part * (1 << 30))))
    chosen = learn.where(test)  # about 2 * most rows
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= chars)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: r["id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], bool)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """The id (and columns ``keep``), the score and the spans (offsets of offending words) of each row."""
    kinds = dict(documents.dtypes)
    carried = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c != text_col]
    columns = [*carried, text_col]
    given = [*columns] if keep and text_col in keep else carried

    def make():
        scorer = model.scorer()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            scores, spans, group, held = [], [], [], 0

            def done() -> None:
                s, at = scorer.scores(group)
                scores.extend(s.tolist())
                spans.extend([{"start": a, "end": b} for a, b in x] for x in at)
                group.clear()

            for raw in text_bytes(batch.column(len(columns) - 1)):
                group.append(raw.decode())
                held += len(raw)
                if held > 3 * GROUP:
                    done()
                    held = 0
            if group:
                done()
            yield {c: batch.column(columns.index(c)) for c in given} | {score_col: scores, spans_col: spans}

        return work

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in given) + f", `{score_col}` double, `{spans_col}` array<struct<start: bigint, end: bigint>>"
    return arrow_map(documents, columns, schema, make)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score(documents, fit(*training_rows(documents, labels, id_col, text_col)), id_col, text_col, keep, score_col, spans_col)
