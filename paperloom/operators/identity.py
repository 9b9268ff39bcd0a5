"""Identity: keys, merging records across sources, staged resolution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from paperloom.functions import scalars as S
from paperloom.functions import udfs as U

#: A title counts as the same from this score on.
STRICT_TITLE = 0.94
#: Two titles of that score have lengths within ``_WIDER`` of each other, and at most ``1 - _RATIO`` of all their letters
#: are unmatched; scores are rounded to three places, hence a little less than ``STRICT_TITLE``.
_RATIO = STRICT_TITLE - 0.0006
_WIDER = (2 - _RATIO) / _RATIO
#: Up to so many unmatched letters titles meet by what is left without them.
_FEW = 2
_KEYS = ("doi", "openalex_id", "s2_id", "s2_corpus_id")


def keyed(papers: DataFrame) -> DataFrame:
    """Papers with their ``key``: the first id that is set, else title and year."""
    columns = {c: F.col(c) if c in papers.columns else F.lit(None).cast("string") for c in (*_KEYS, "pmid", "omid")}
    return papers.withColumn("key", S.paper_key(columns["doi"], columns["openalex_id"], columns["s2_id"], columns["s2_corpus_id"], F.col("title"), F.col("year"), columns["pmid"], columns["omid"]))


def merge(papers: DataFrame, order: str = "source_rank") -> DataFrame:
    """One row for each key: every field from the first source (by ``order``) that has it. Not transitive: rows known by
    different ids stay apart."""
    fields = [c for c in papers.columns if c not in ("key", order)]
    kinds = dict(papers.dtypes)

    def filled(c: str):
        value = F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.when(F.size(c) > 0, F.col(c)) if kinds[c].startswith(("array", "map")) else F.col(c)
        return F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(c)

    rows = papers if "key" in papers.columns else keyed(papers)
    return rows.groupBy("key").agg(*[filled(c) for c in fields], F.count(F.lit(1)).alias("n_records"))


def merge_by_title(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary rows and those of secondary whose title is new (each once, the smallest id)."""
    title = lambda: F.lower(F.trim(F.coalesce("title", F.lit(""))))
    fresh = secondary.withColumn("_t", title()).where("_t <> ''").join(primary.select(title().alias("_t")).distinct(), "_t", "left_anti")
    once = fresh.groupBy("_t").agg(F.min_by(F.struct(*secondary.columns), "id").alias("r")).select("r.*")
    return primary.unionByName(once)


def supplemented(works: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Citing papers of each work: the first source's and, where it found too few for the work's ``citation_count``, those of a
    second source whose title is new to that work (each once, the smallest id). Papers have ``work_id, id, title``."""
    title = lambda: F.lower(F.trim(F.coalesce("title", F.lit(""))))
    fetched = primary.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n"))
    asked = works.select("work_id", "citation_count").join(fetched, "work_id", "left").where(S.should_supplement_fetch(F.col("citation_count"), F.coalesce("_n", F.lit(0))))
    fresh = secondary.join(asked.select("work_id"), "work_id", "left_semi").withColumn("_t", title()).where("_t <> ''").join(primary.select("work_id", title().alias("_t")).distinct(), ["work_id", "_t"], "left_anti")
    once = fresh.groupBy("work_id", "_t").agg(F.min_by(F.struct(*secondary.columns), "id").alias("r")).select("r.*")
    return primary.unionByName(once)


def get_by_ids(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """The paper of each asked id (``pos, id``), by position; nulls where it isn't known, the least row where several are."""
    fields = [c for c in papers.columns if c != "id"]
    known = papers.where("id is not null").groupBy("id").agg(F.min(F.struct(*fields)).alias("p"))
    return ids.select("pos", "id").join(known, "id", "left").select("pos", "id", *[F.col(f"p.{c}").alias(c) for c in fields]).orderBy("pos")


def get_by_doi(dois: DataFrame, papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers by DOI in whatever form either side gives it, each asked one once; at most ``limit`` of them."""
    wanted = dois.select(F.lower(S.doi_key(F.col("doi"))).alias("_doi")).where("_doi is not null").distinct()
    found = papers.withColumn("_doi", F.lower(S.doi_key(F.col("doi")))).join(wanted, "_doi", "left_semi").drop("_doi")
    return found.orderBy("id").limit(limit) if limit else found


def s2_identifiers(identities: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``req, s2_identifier``: an identity's own id, else its corpus id, else those of what ``resolved`` (``req, s2_id,
    s2_corpus_id``) found for it; null where there is none."""
    of = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.concat(F.lit("CorpusId:"), F.nullif(b, F.lit(""))))
    own = of(F.col("s2_id"), F.col("s2_corpus_id"))
    if resolved is None:
        return identities.select("req", own.alias("s2_identifier"))
    second = resolved.groupBy("req").agg(F.min(of(F.col("s2_id"), F.col("s2_corpus_id"))).alias("_second"))
    return identities.join(second, "req", "left").select("req", F.coalesce(own, "_second").alias("s2_identifier"))


def enrich(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill an edge table's blanks from metadata, by id or else by DOI."""
    by = lambda c, k: metadata.select(F.col(k).alias(c), F.struct("title", "year", "citation_count").alias(f"_{c}")).where(F.col(c).isNotNull()).dropDuplicates([c])
    rows = edges.join(by("openalex_id", "openalex_id"), "openalex_id", "left").join(by("doi", "doi"), "doi", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_openalex_id.{c}"), F.col(f"_doi.{c}")) for c in ("title", "year", "citation_count")}
    return rows.withColumns(filled).drop("_openalex_id", "_doi")


def _pieces(n: int) -> tuple[int, int]:
    """Number and length of the pieces of a title of ``n`` letters, of which every title of a high score holds one as it is:
    one more than the letters that may be unmatched in both."""
    many = math.floor((1 - _RATIO) * (n + math.floor(_WIDER * n + 1e-9)) + 1e-9) + 1
    return many, n // many


def _unmatched(n: int, m: int) -> int:
    """The most letters that may be unmatched in both of two titles of these lengths."""
    return math.floor((1 - _RATIO) * (n + m) + 1e-9)


def _near(n: int) -> range:
    """Lengths that a title may have to match one of ``n`` letters."""
    return range(math.ceil(n / _WIDER - 1e-9), math.floor(n * _WIDER + 1e-9) + 1)


def _without(t: str, many: int) -> set[str]:
    return {t} if not many else {t[:i] + t[i + 1 :] for i in range(len(t))} if many == 1 else {t[:i] + t[i + 1 : j] + t[j + 1 :] for j in range(len(t)) for i in range(j)}


def title_pieces(title: str) -> list[str]:
    """Keys of a title that is asked for. Where at most ``_FEW`` letters are unmatched, what is left of both titles without
    theirs is the same, so what is left is the key, with the number of letters that the other title loses; a piece
    would be one that short titles of few words share with a great many. Else its pieces."""
    t = title.lower().strip()
    allowed = [_unmatched(len(t), m) for m in _near(len(t))]
    few = max((k for k in allowed if k <= _FEW), default=-1)
    keys = {f"-{lost} {left}" for own in range(few + 1) for left in _without(t, own) for lost in range(few - own + 1)}
    if max(allowed) > _FEW:
        many, size = _pieces(len(t))
        keys |= {f"{size} {t[i * size : (i + 1) * size]}" for i in range(many)}
    return sorted(keys)


def title_keys(title: str) -> list[str]:
    """All keys by which a title can be found: what is left without a few letters, and its substrings of the sizes that
    titles of a near length are cut into."""
    t = title.lower().strip()
    n = len(t)
    few = max((k for m in _near(n) for k in [_unmatched(n, m)] if k <= _FEW), default=-1)
    sizes = {_pieces(m)[1] for m in _near(n) if _unmatched(n, m) > _FEW}
    keys = {f"-{lost} {left}" for lost in range(few + 1) for left in _without(t, lost)}
    return sorted(keys | {f"{size} {t[i : i + size]}" for size in sizes for i in range(n - size + 1)})


@F.pandas_udf(ArrayType(StringType()))
def _pieces_udf(titles: pd.Series) -> pd.Series:
    return titles.map(title_pieces)


@F.pandas_udf(ArrayType(StringType()))
def _keys_udf(titles: pd.Series) -> pd.Series:
    return titles.map(title_keys)


def resolve(requests: DataFrame, papers: DataFrame, strict: bool = True) -> DataFrame:
    """Papers that requests (``req, id, doi, arxiv_id, title``) mean: by id, else DOI, else arXiv id, else title.

    Titles are compared by ratio where they share a piece that no title of a score of ``STRICT_TITLE`` can lack, so no request
    meets every paper. Without ``strict`` any score counts, and each request's title meets all.
    """
    known = papers.withColumns({"_doi": F.lower(S.doi_key(F.col("doi"))), "_arxiv": F.lower(S.arxiv_key(F.col("arxiv_id")))})
    asked = requests.withColumns({"_doi": F.lower(S.doi_key(F.col("doi"))), "_arxiv": F.lower(S.arxiv_key(F.col("arxiv_id")))}).select("req", F.col("id").alias("_id"), "_doi", "_arxiv", F.col("title").alias("_title"))
    stage = lambda n, a, b: asked.where(F.col(a).isNotNull()).join(known.select("id", F.col(b).alias(a)).where(F.col(a).isNotNull()), a).select("req", "id", F.lit(n).alias("stage"), F.lit(1.0).alias("score"))
    titles, wanted = known.where("title <> ''").select("id", "title"), asked.where("_title <> ''").select("req", "_title")
    if strict:
        # Keys go as hashes and without titles: one that collides only adds a pair to score.
        keys = titles.select("id", F.explode(_keys_udf(F.col("title"))).alias("_k")).select(F.xxhash64("_k").alias("_k"), F.col("id").alias("_id"))
        asked_keys = wanted.select("req", "_title", F.explode(_pieces_udf(F.col("_title"))).alias("_k")).select("req", "_title", F.xxhash64("_k").alias("_k"))
        met = keys.join(asked_keys.hint("shuffle_hash"), "_k").select("req", "_title", "_id").distinct()
        near = met.join(titles, F.col("_id").eqNullSafe(F.col("id"))).select("req", "_title", "id", "title")
    else:
        near = wanted.crossJoin(titles)
    near = near.withColumn("score", U.title_score_udf(F.col("_title"), F.col("title")))
    near = near.where(F.col("score") >= STRICT_TITLE) if strict else near
    found = stage(0, "_id", "id").unionByName(stage(1, "_doi", "_doi")).unionByName(stage(2, "_arxiv", "_arxiv")).unionByName(near.select("req", "id", F.lit(3).alias("stage"), "score"))
    best = found.groupBy("req").agg(F.min_by(F.struct("id", "stage", "score"), F.struct("stage", (-F.col("score")).alias("s"), F.col("id").alias("i"))).alias("b"))
    return requests.select("req").join(best, "req", "left").select("req", F.col("b.id").alias("id"), F.col("b.stage").alias("stage"), F.col("b.score").alias("score"))
