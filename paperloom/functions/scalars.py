"""Scalar expressions: ids, keys, weights, scores, small array helpers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORK_PREFIX = "https://openalex.org/"


def first_truthy(*columns: Column | str, kind: str = "string") -> Column:
    """First argument that is neither null nor empty ('' for strings, 0 for numbers, no elements for arrays)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if kind == "array":
        return reduce(lambda rest, c: F.when(F.size(F.coalesce(c, F.array())) > 0, c).otherwise(rest), cols[::-1][1:], cols[-1])
    empty = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(*[F.nullif(c, empty) for c in cols])


def compact_id(column: Column) -> Column:
    """Id without its URL prefix; null becomes ''."""
    return F.coalesce(F.replace(column.cast("string"), F.lit(WORK_PREFIX), F.lit("")), F.lit(""))


def int_or_null(column: Column) -> Column:
    return column.try_cast("int")


def int_or_zero(column: Column) -> Column:
    return F.coalesce(column.try_cast("int"), F.lit(0))


def doi_key(column: Column) -> Column:
    """DOI without URL or scheme prefixes; empty becomes null."""
    value = F.trim(column)
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:", "DOI:"):
        value = F.replace(value, F.lit(prefix), F.lit(""))
    return F.nullif(F.trim(value), F.lit(""))


def arxiv_key(column: Column) -> Column:
    """arXiv id without URL, file ending, scheme, query or fragment; empty becomes null."""
    value = F.regexp_replace(F.trim(column), r"(?i)^https?://arxiv\.org/(abs|pdf)/", "")
    value = F.regexp_replace(F.regexp_replace(value, r"(?i)\.pdf$", ""), r"(?i)^arxiv:", "")
    return F.nullif(F.trim(F.regexp_extract(value, r"^([^?#]*)", 1)), F.lit(""))


def paper_key(doi: Column, openalex: Column, s2: Column, corpus: Column, title: Column, year: Column, pmid: Column | None = None, omid: Column | None = None) -> Column:
    """Identity key: the first id that is set, else title and year."""
    named = [("doi", doi), ("openalex_id", openalex), ("s2_id", s2), ("s2_corpus_id", corpus), ("pmid", pmid), ("omid", omid)]
    keys = [F.concat(F.lit(f"{n}:"), F.lower(F.nullif(c.cast("string"), F.lit("")))) for n, c in named if c is not None]
    by_title = F.concat(F.lit("title:"), F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit(":"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(*keys, by_title)


def work_identifier(column: Column) -> Column:
    """Point-lookup form of an id: a DOI becomes its URL form, an entity URL its bare id."""
    value = F.trim(column)
    return (
        F.when(value.startswith(WORK_PREFIX), F.replace(value, F.lit(WORK_PREFIX), F.lit("")))
        .when(value.startswith("https://doi.org/"), value)
        .when(F.lower(value).startswith("doi:"), F.concat(F.lit("https://doi.org/"), value.substr(F.lit(5), F.length(value))))
        .when(value.startswith("10."), F.concat(F.lit("https://doi.org/"), value))
        .otherwise(value)
    )


def s2_identifier(column: Column) -> Column:
    """Citation-service form of an id: CorpusId, arXiv, DOI or bare."""
    value = F.trim(column)
    arxiv = arxiv_key(value)
    return (
        F.when(F.lower(value).startswith("corpusid:"), F.concat(F.lit("CorpusId:"), value.substr(F.lit(10), F.length(value))))
        .when(value.rlike(r"^\d+$"), F.concat(F.lit("CorpusId:"), value))
        .when(value.rlike(r"(?i)^(arxiv:|https?://arxiv\.org/)"), F.concat(F.lit("ARXIV:"), arxiv))
        .when(value.rlike(r"(?i)^(doi:|https?://doi\.org/|10\.)"), F.concat(F.lit("DOI:"), doi_key(value)))
        .otherwise(value)
    )


def pid_map(column: Column) -> Column:
    """``scheme:value`` tokens separated by white space, as a map; the last of a scheme wins."""
    tokens = F.filter(F.split(F.trim(F.coalesce(column, F.lit(""))), r"\s+"), lambda t: F.instr(t, ":") > 0)
    pairs = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^([^:]*):", 1).alias("k"), F.regexp_extract(t, r"^[^:]*:(.*)$", 1).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def counting_weight(size: Column, counting: str) -> Column:
    """1 (full) or 1/n (fractional); 0 where there is nothing to count."""
    if counting not in ("full", "fractional"):
        raise ValueError("counting must be full or fractional")
    return F.when(size <= 0, F.lit(0.0)).otherwise(1.0 / size if counting == "fractional" else F.lit(1.0))


def h_index(values: Column) -> Column:
    """Largest h with h values of at least h, of an array of counts."""
    ranked = F.sort_array(values, asc=False)
    return F.size(F.filter(F.transform(ranked, lambda v, i: v >= i + 1), lambda ok: ok)).cast("bigint")


def sigmoid(x: Column, center: float, steepness: float) -> Column:
    power = -steepness * (x - F.lit(float(center)))
    return F.when(power > 700, F.lit(0.0)).when(power < -700, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(F.least(F.greatest(power, F.lit(-700.0)), F.lit(700.0)))))


def recency(year: Column, current_year: int, shift: int = 7, steepness: float = 0.7) -> Column:
    """0 without a year, 1 from the current year on, else a logistic curve around ``shift`` years ago."""
    return F.when(year.isNull() | (year == 0), F.lit(0.0)).when(year >= current_year, F.lit(1.0)).otherwise(sigmoid(year.cast("double"), current_year - shift, steepness))


def centrality(citations: Column, center: int = 50, steepness: float = 1.8) -> Column:
    count = F.coalesce(citations, F.lit(0))
    return F.when(count <= 0, F.lit(0.0)).otherwise(sigmoid(F.log(F.greatest(count, F.lit(0)) + 1.0), math.log(center + 1), steepness))


def in_domain_score(inside: Column, total: Column) -> Column:
    """n * (n / total)^2; null where nothing is known to be cited in all."""
    return F.when(total > 0, inside * F.pow(inside / total, F.lit(2.0)))


def should_supplement_lookup(expected: Column, found: Column, limit: int) -> Column:
    """Whether a second source is asked: nothing found, or a gap of a third within the limit."""
    return F.when(found == 0, F.lit(True)).when(expected.isNull() | (expected <= 0) | (expected > limit), F.lit(False)).otherwise(F.abs(expected - found) / expected >= 0.33)


def should_supplement_fetch(total: Column, fetched: Column, least: int = 300) -> Column:
    return F.when(fetched == 0, F.lit(True)).when(total.isNull() | (total <= least), F.lit(False)).otherwise(F.abs(total - fetched) / total >= 0.33)


def url_type(url: Column) -> Column:
    """Kind of a homepage by its host."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return (
        F.when(host.contains("github.io") | host.contains("github.com"), F.lit("github_pages"))
        .when(host.contains("sites.google.com"), F.lit("google_sites"))
        .when(host.contains(".edu") | host.contains(".ac."), F.lit("institutional"))
        .when(host == "", F.lit("unknown"))
        .otherwise(F.lit("personal"))
    )


def topic_text(column: Column) -> Column:
    """Lower case, plural folding, single spaces."""
    folded = F.replace(F.replace(F.lower(F.trim(column)), F.lit("sciences"), F.lit("science")), F.lit("studies"), F.lit("study"))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def hierarchical_match(query: Column, candidate: Column) -> Column:
    """Equal after folding, or the candidate goes on with further words."""
    q, c = topic_text(query), topic_text(candidate)
    return F.coalesce((q != "") & (c != "") & ((q == c) | c.startswith(F.concat(q, F.lit(" ")))), F.lit(False))


def topic_filter(topic_id: Column) -> Column:
    bare = compact_id(topic_id)
    column = F.when(bare.startswith("domains/"), F.lit("topics.domain.id")).when(bare.startswith("fields/"), F.lit("topics.field.id")).when(bare.startswith("subfields/"), F.lit("topics.subfield.id")).otherwise(F.lit("topics.id"))
    return F.concat(column, F.lit(":"), bare)


def inverted_index_text(index: Column) -> Column:
    """Text of a token-to-positions map; on one position the last token in byte order wins."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    ordered = F.array_sort(places)
    kept = F.filter(F.transform(ordered, lambda x, i: F.struct(x.alias("x"), F.get(ordered, i + 1)["p"].alias("n"))), lambda z: z["n"].isNull() | (z["n"] != z["x"]["p"]))
    return F.array_join(F.transform(kept, lambda z: z["x"]["t"]), " ")


def positioned_authors(authorships: Column) -> Column:
    """An API's authorships as a saved work's authors, with their positions from 1."""
    author = lambda x, i: F.struct(
        compact_id(x["author"]["id"]).alias("id"), x["author"]["display_name"].alias("display_name"), x["author"]["orcid"].alias("orcid"), (i + 1).alias("position"), x["author_position"].alias("author_position"), x["is_corresponding"].alias("is_corresponding"),
        F.transform(x["institutions"], lambda n: F.struct(compact_id(n["id"]).alias("id"), n["display_name"].alias("display_name"), n["country_code"].alias("country_code"), n["type"].alias("type"))).alias("institutions"),
    )
    return F.transform(authorships, author)


def count() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))
