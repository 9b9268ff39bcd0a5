"""Keyphrases: pattern candidates, TF-IDF and hash-vector ranking, non-redundant choice."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from paperloom.functions import text as T
from paperloom.functions import udfs as U
from paperloom.functions.scalars import count
from paperloom.functions.udfs import _WORDS, hash_vector
from paperloom.session import tabled

_STOP = tuple(dict.fromkeys((*T.ENGLISH_STOPWORDS, *T.GENERIC_TERMS, *T.RHETORICAL_TERMS)))
#: No phrase runs over a stop word, and none that holds one of the others is kept.
_BREAKS = frozenset((*_STOP, *T.PHRASE_MARKUP_TERMS, *T.FORMULA_TERMS))
_LOW, _SYMBOLS = frozenset(T.LOW_SIGNAL_TERMS), frozenset(T.MATH_SYMBOLS)
#: Texts turned to arrays of phrases at a time.
_AT_ONCE = 256
_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))


def phrase_counts(text: str, custom: frozenset[str] = frozenset()) -> list[dict[str, int]]:
    """Occurrences of a text's candidate phrases of one to four words: what ``clean_phrase`` makes of each span, cut at stop
    words, without the phrases that ``is_weak_phrase`` names."""
    spans = re.sub(r"[.!?;:\n\r\t]+", "\n", re.sub("<[^>]+>", " ", text))
    if not spans.isascii():
        spans = unicodedata.normalize("NFKD", spans)
    # A tag is one only inside a span.
    lines = re.sub(r"<[^>\n]+>", " ", spans.lower()).encode("ascii", "replace").translate(_PLAIN).decode("ascii").split("\n")
    made: list[list[str]] = [[], [], [], []]
    for line in lines:
        words, seg = line.split(), []
        for word in [*words, ""]:
            if word and word not in _BREAKS:
                seg.append(word)
                continue
            if seg:
                grams = seg
                made[0] += [w for w in seg if len(w) > 3 and w not in _LOW]
                for n in (1, 2, 3):
                    grams = [f"{g} {w}" for g, w in zip(grams, seg[n:])]  # noqa: B905
                    made[n] += grams
                seg = []
    # Two words of which one is a lone letter, but for a symbol; phrases that begin with an "s" left by an apostrophe.
    lone = lambda w: len(w) == 1 and w not in _SYMBOLS
    made[1] = [g for g in made[1] if not ((g[1] == " " or g[-2] == " ") and any(map(lone, g.split(" "))))]
    made[1:] = [[g for g in grams if not g.startswith("s ")] for grams in made[1:]]
    if custom:
        made = [[g for g in grams if g.split(" ", 1)[0] not in custom and g.rsplit(" ", 1)[-1] not in custom] for grams in made]
    return [Counter(grams) for grams in made]


def most_frequent(counts: list[dict[str, int]], limit: int) -> list[tuple[str, int, int]]:
    """Phrase, occurrences and words of the first ``limit`` by occurrences, words and phrase, all falling."""
    found = sorted(((n, words, term) for words, own in enumerate(counts, 1) for term, n in own.items() if n > 1), reverse=True)[:limit]
    for words in range(len(counts), 0, -1):
        if len(found) >= limit:
            break
        once = [term for term, n in counts[words - 1].items() if n == 1]
        if len(once) > limit - len(found):
            once = nlargest(limit - len(found), once)
        found += [(1, words, term) for term in once]
    return [(term, n, words) for n, words, term in found]


def _listed(docs: DataFrame, text: Column) -> DataFrame:
    """The texts of each document, of several rows if its id comes more than once."""
    return docs.groupBy("doc_id").agg(F.collect_list(F.coalesce(text, F.lit(""))).alias("texts"))


def _mapped(rows: DataFrame, schema: str, work: Callable[[dict], Iterator[tuple] | list]) -> DataFrame:
    """Rows of ``doc_id`` and the arrays of ``schema``, the tuples that ``work`` gives for a row being their elements."""
    target = to_arrow_schema(StructType([rows.schema["doc_id"], *_parse_datatype_string(schema)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), _AT_ONCE):
                batch = whole.slice(low, _AT_ONCE)
                sizes, flat = [0], []
                for row in batch.to_pylist():
                    flat += work(row)
                    sizes.append(len(flat))
                columns = list(zip(*flat, strict=True)) if flat else [()] * (len(target) - 1)
                arrays = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(c, f.type.value_type)).cast(f.type) for c, f in zip(columns, list(target)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(target.field(0).type), *arrays], schema=target)

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *_parse_datatype_string(schema)]))


def _rows(arrays: DataFrame) -> DataFrame:
    """One row for each element of ``terms`` and the arrays beside it. The arrays stay known with the rows, so that what
    ranks them needn't bring a document's rows together again."""
    fields = arrays.columns[1:]
    names = {"terms": "term", "counts": "n"}
    rows = arrays.select("doc_id", F.explode(F.arrays_zip(*fields)).alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(names.get(c, c)) for c in fields])
    rows._arrays = arrays
    return rows


def candidates(docs: DataFrame, text: Column, custom: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """Candidate phrases of each document: ``doc_id``, ``term``, ``n`` (occurrences), ``words``, best first up to ``limit``.

    They are made and counted where the text is: only texts are shuffled, by document, never phrases."""
    weak = frozenset(custom)

    def work(row: dict) -> list[tuple[str, int, int]]:
        counts = [Counter(), Counter(), Counter(), Counter()]
        for t in row["texts"]:
            for own, more in zip(counts, phrase_counts(t, weak), strict=True):
                own.update(more)
        return most_frequent(counts, limit)

    return _rows(_mapped(_listed(docs, text), "terms array<string>, counts array<bigint>, words array<int>", work))


def prior(n: Column, words: Column, term: Column) -> Column:
    """Length prior, lowered for single words and raised for repetition."""
    base = T.phrase_quality(term) * F.when(words == 1, 0.72).otherwise(1.0)
    return base * F.when(n > 1, 1.0 + F.least(F.lit(0.18), F.log1p(n.cast("double")) * 0.05)).otherwise(1.0)


def _tfidf_scored(rows: DataFrame, df: DataFrame, total: DataFrame | int) -> DataFrame:
    rows = rows.join(df, "term")
    rows = rows.withColumn("total", F.lit(total)) if isinstance(total, int) else rows.crossJoin(F.broadcast(total))  # one row
    idf = F.log((1.0 + F.col("total")) / (1.0 + F.col("doc_frequency"))) + 1.0
    bonus = F.log(1.0 + F.col("doc_frequency")) * F.when(F.col("words") == 1, 0.25).otherwise(0.75)
    return rows.select("doc_id", "term", "words", F.col("n").alias("candidate_count"), "doc_frequency", idf.alias("tfidf_score"), prior(F.col("n"), F.col("words"), F.col("term")).alias("quality_score"), ((0.7 * idf + bonus) * prior(F.col("n"), F.col("words"), F.col("term"))).alias("score"))


def tfidf_contenders(found: list[tuple[str, int, int]], total: int, most: int, top: int) -> list[tuple[str, int, int]]:
    """Of a document's candidates (phrase, occurrences, words) those that ``nonredundant`` may choose, whatever their
    document frequencies between 1 and ``most`` are.

    A phrase is sure if no candidate that holds it can score as high: it is chosen unless ``top`` others were before. What
    scores less than ``top`` sure ones at any frequency is therefore never chosen, and bars no other."""
    bounds: dict[tuple[int, int], tuple[float, float]] = {}

    def bound(n: int, words: int) -> tuple[float, float]:
        if (n, words) not in bounds:
            quality = {1: 0.92 * 0.72, 2: 1.0, 3: 0.94, 4: 0.82}.get(words, 0.65) * (1.0 + min(0.18, math.log1p(n) * 0.05) if n > 1 else 1.0)
            ends = [(0.7 * (math.log((1.0 + total) / (1.0 + df)) + 1.0) + math.log(1.0 + df) * (0.25 if words == 1 else 0.75)) * quality for df in (1, most)]
            bounds[n, words] = min(ends), max(ends)
        return bounds[n, words]

    holders: dict[str, float] = {}
    for term, n, words in found:
        if words > 2:
            high, parts = bound(n, words)[1], term.split(" ")
            for size in range(2, words):
                for i in range(words - size + 1):
                    part = " ".join(parts[i : i + size])
                    if holders.get(part, -math.inf) < high:
                        holders[part] = high
    near = 1e-9  # sums differ by less between engines
    sure = [low for term, n, words in found for low in [bound(n, words)[0]] if (term not in _LOW if words == 1 else holders.get(term, -math.inf) < low - near)]
    if len(sure) < top:
        return found
    least = nlargest(top, sure)[-1] - near
    return [x for x in found if bound(*x[1:])[1] >= least]


def tfidf(found: DataFrame, n_docs: int | None = None) -> DataFrame:
    """Scores of candidates over a corpus: smoothed inverse document frequency, document frequency bonus, prior.

    What ``candidates`` returned is written once, and ``nonredundant`` then joins only the phrases that it may choose."""
    arrays = getattr(found, "_arrays", None)
    if arrays is not None:
        arrays = tabled(arrays)
        found = _rows(arrays)
    df = found.groupBy("term").agg(count().alias("doc_frequency"))
    total = found.select("doc_id").distinct().agg(count().alias("total")) if n_docs is None else n_docs
    scored = _tfidf_scored(found, df, total)
    if arrays is not None:

        def contenders(top: int) -> DataFrame:
            most = arrays.where("size(terms) > 0").count()
            if not most:
                return scored
            own = most if n_docs is None else n_docs
            work = lambda row: tfidf_contenders(list(zip(row["terms"], row["counts"], row["words"], strict=True)), own, most, top)
            return _tfidf_scored(_rows(_mapped(arrays, "terms array<string>, counts array<bigint>, words array<int>", work)), df, own)

        scored._contenders = contenders
    return scored


def hash_scores(texts: list[str], found: list[tuple[str, int, int]], dimensions: int, kept: dict) -> Iterator[tuple[str, int, int, float]]:
    """Phrases with their words, occurrences and score, for each of a document's texts; what ``hash_vector`` and ``U.cosine``
    give, from the few places of a phrase that aren't zero. ``kept``: places and signs of words."""

    def place(word: str) -> tuple[int, float]:
        if word not in kept:
            if len(kept) > 1 << 18:
                kept.clear()
            own = hash_vector(word, dimensions)
            at = int(np.flatnonzero(own)[0])
            kept[word] = at, float(own[at])
        return kept[word]

    vectors = []
    for text in texts:
        v = np.zeros(dimensions, np.float32)
        for word, n in Counter(_WORDS.findall(text.lower())).items():
            at, sign = place(word)
            v[at] += n * sign
        norm = float(np.linalg.norm(v))
        d = (v / norm if norm else v).astype(np.float64)
        vectors.append((d.tolist(), float(np.sqrt(np.add.accumulate(d * d)[-1]))))
    for term, n, words in found:
        places: dict[int, float] = {}
        for word in term.split(" "):
            at, sign = place(word)
            places[at] = places.get(at, 0.0) + sign
        square = sum([x * x for x in places.values()])
        if (square, words) not in kept:
            # Shares of a unit vector, rounded as in one.
            kept[square, words] = {float(x): float(np.float32(x) / np.sqrt(np.float32(square))) for x in range(-words, words + 1) if x} if square else {}
        unit, length, bonus = kept[square, words], 0.0, min(0.06, 0.02 * (words - 1))
        p = [(at, unit[x]) for at, x in sorted(places.items()) if x]
        for _, x in p:
            length += x * x
        length = math.sqrt(length)
        for d, norm in vectors:
            dot = 0.0
            for at, x in p:
                dot += d[at] * x
            both = norm * length
            yield term, words, n, (float(dot) / both if both else 0.0) + bonus


def hash_ranked(found: DataFrame, texts: DataFrame, dimensions: int = 384) -> DataFrame:
    """Cosine of a document's and a phrase's hash vectors, plus a small bonus for length. ``texts``: doc_id, text.

    What ``candidates`` returned meets its document's texts as one array, and no vector is shuffled."""
    arrays = getattr(found, "_arrays", None)
    if arrays is None:
        arrays = found.groupBy("doc_id").agg(F.collect_list(F.struct("term", "n", "words")).alias("x")).select("doc_id", F.col("x.term").alias("terms"), F.col("x.n").alias("counts"), F.col("x.words").alias("words"))
    kept: dict = {}
    work = lambda row: hash_scores(row["texts"], list(zip(row["terms"], row["counts"], row["words"], strict=True)), dimensions, kept)
    scores = _mapped(arrays.join(_listed(texts, F.col("text")), "doc_id"), "terms array<string>, words array<int>, candidate_count array<bigint>, score array<double>", work)
    return _rows(scores)


def lexical_ranked(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Share of a phrase's words that the text holds, plus a bonus for length; where no vectors are wanted."""
    words = texts.select("doc_id", F.array_distinct(F.split(T.clean_phrase(U.nfkd_udf(F.col("text"))), " ")).alias("d"))
    own = F.split("term", " ")
    overlap = F.size(F.array_intersect(own, F.col("d"))) / F.size(F.array_distinct(own))
    return found.join(words, "doc_id").select("doc_id", "term", "words", F.col("n").alias("candidate_count"), (overlap + F.least(F.lit(0.12), 0.04 * (F.col("words") - 1))).alias("score"))


def nonredundant(scored: DataFrame, top: int = 10) -> DataFrame:
    """Best phrases of each document without those that a better, longer one contains; a fold over the sorted array."""
    arrays = getattr(scored, "_arrays", None)
    if arrays is not None:
        ranked = arrays.select("doc_id", F.array_sort(F.zip_with("score", "terms", lambda s, t: F.struct((-s).alias("s"), t.alias("term")))).alias("all"))
    else:
        scored = getattr(scored, "_contenders", lambda _: scored)(top)
        ranked = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("all"))

    def nested(kept: Column, term: Column) -> Column:
        many = F.instr(term, " ") > 0
        inside = F.exists(kept, lambda k: (F.length(k["term"]) > F.length(term)) & F.contains(F.concat(F.lit(" "), k["term"], F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" "))))
        longer = F.exists(kept, lambda k: F.instr(k["term"], " ") > 0)
        return F.when(many, inside).otherwise(term.isin(*T.LOW_SIGNAL_TERMS) & longer)

    kept = F.aggregate("all", F.array().cast("array<struct<s: double, term: string>>"), lambda done, x: F.when((F.size(done) >= top) | nested(done, x["term"]), done).otherwise(F.concat(done, F.array(x))))
    rows = ranked.select("doc_id", F.posexplode(kept).alias("rank", "x"))
    return rows.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("x.term").alias("term"), (-F.col("x.s")).alias("score"))


def match_source_rows(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """The source row of each refined term in its document: the same term, else the best ranked one that contains it or that it contains."""
    same = terms.alias("t").join(rows.alias("r"), (F.col("t.doc_id") == F.col("r.doc_id")) & ((F.col("t.term") == F.col("r.term")) | F.contains(F.col("r.term"), F.col("t.term")) | F.contains(F.col("t.term"), F.col("r.term"))), "left")
    order = F.struct((F.col("t.term") != F.col("r.term")).alias("a"), F.col("r.rank").alias("b"))
    return same.groupBy(F.col("t.doc_id").alias("doc_id"), F.col("t.term").alias("term")).agg(F.min_by("r.term", order).alias("source_term"))


def refine(given: DataFrame, rows: DataFrame, most: int = 10) -> DataFrame:
    """Phrases that a model chose for each document (``doc_id``, ``items``: an array of structs ``term, category,
    source_terms``), normalised and ranked from 1, with the score of their source row among ``rows`` (``doc_id, rank, term,
    score``). Empty phrases go; a document without any keeps its rows, with a null ``llm_rank``."""
    clean = lambda c: T.clean_phrase(U.nfkd_udf(F.coalesce(c, F.lit(""))))
    listed = given.select("doc_id", F.posexplode(F.slice("items", 1, most)).alias("p", "x"))
    terms = listed.select("doc_id", (F.col("p") + 1).alias("llm_rank"), clean(F.col("x.term")).alias("term"), F.col("x.category").alias("category"), F.array_join("x.source_terms", ";").alias("source_terms")).where("term <> ''")
    matched = match_source_rows(terms.select("doc_id", "term").distinct(), rows).join(rows.select("doc_id", F.col("term").alias("source_term"), "score"), ["doc_id", "source_term"], "left")
    refined = terms.join(matched, ["doc_id", "term"]).select("doc_id", "llm_rank", "term", "score", "category", "source_terms")
    return refined.unionByName(rows.join(terms.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "term", "score"), allowMissingColumns=True)
