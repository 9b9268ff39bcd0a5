"""Records of scholarly services as rows: each function turns a service's JSON rows into the common schemas.

Readers give the JSON with Spark (``spark.read.json``); nothing here calls a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S


def _field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field, or null where the schema lacks it."""
    here = df.schema
    for part in path.split("."):
        if not hasattr(here, "fieldNames") or part not in here.fieldNames():
            return F.lit(None).cast(kind)
        here = here[part].dataType
    return F.col(path)


def openalex_works(raw: DataFrame) -> DataFrame:
    """API works as saved works: compact ids, five topics, positioned authors."""
    topic = lambda t: F.struct(S.compact_id(t["id"]).alias("id"), t["display_name"].alias("name"), t["score"].cast("double").alias("score"))
    source = F.struct(S.compact_id(F.col("primary_location.source.id")).alias("id"), F.col("primary_location.source.display_name").alias("name"), F.col("primary_location.source.type").alias("type"), F.col("primary_location.source.issn_l").alias("issn_l"))
    return raw.select(
        S.compact_id(F.col("id")).alias("id"), "doi", S.first_truthy("title", "display_name").alias("title"), F.col("publication_year").cast("int").alias("publication_year"), "publication_date", "type", S.int_or_zero(F.col("cited_by_count").cast("string")).alias("cited_by_count"), F.col("open_access.is_oa").alias("is_oa"),
        source.alias("source"), F.transform(F.slice("topics", 1, 5), topic).alias("topics"), S.positioned_authors(F.col("authorships")).alias("authors"), F.transform(F.filter("referenced_works", lambda r: r.isNotNull()), S.compact_id).alias("referenced_works"),
    )


def openalex_papers(raw: DataFrame) -> DataFrame:
    """API works as identity rows of the citation graph."""
    return raw.select(
        S.compact_id(F.col("id")).alias("openalex_id"), S.doi_key(F.col("doi")).alias("doi"), "title", F.col("publication_year").cast("int").alias("year"), F.col("primary_location.source.display_name").alias("venue"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("cited_by_count").cast("int").alias("citation_count"), F.size("referenced_works").alias("reference_count"), F.lit("openalex").alias("provider"), F.lit(0).alias("source_rank"),
    )


def s2_papers(raw: DataFrame) -> DataFrame:
    """Semantic-graph papers as identity rows; rows without any id go."""
    ids = lambda k: F.element_at("externalIds", k)
    rows = raw.select(
        F.col("paperId").alias("s2_id"), F.coalesce(F.col("corpusId").cast("string"), ids("CorpusId")).alias("s2_corpus_id"), S.doi_key(ids("DOI")).alias("doi"), S.arxiv_key(ids("ArXiv")).alias("arxiv_id"), "title", F.col("year").cast("int").alias("year"),
        F.col("citationCount").cast("int").alias("citation_count"), F.col("referenceCount").cast("int").alias("reference_count"), F.lit("semantic_scholar").alias("provider"), F.lit(2).alias("source_rank"),
    )
    return rows.where(F.coalesce("s2_id", "s2_corpus_id", "doi").isNotNull())


def opencitations_edges(raw: DataFrame, side: str = "cited") -> DataFrame:
    """Edges as identity rows of their ``citing`` or ``cited`` end."""
    ids = S.pid_map(F.col(side))
    return raw.select(ids.alias("provider_ids")).select(S.doi_key(F.element_at("provider_ids", "doi")).alias("doi"), F.upper(F.element_at("provider_ids", "openalex")).alias("openalex_id"), F.element_at("provider_ids", "pmid").alias("pmid"), F.element_at("provider_ids", "omid").alias("omid"), "provider_ids", F.lit("opencitations").alias("provider"), F.lit(1).alias("source_rank"))


def content_value(column: Column, is_wrapped: bool) -> Column:
    """OpenReview wraps fields as ``{value: x}`` in its second API."""
    return column["value"] if is_wrapped else column


def openreview_notes(raw: DataFrame) -> DataFrame:
    """Notes as conference records; both API versions."""
    content = raw.schema["content"].dataType
    wrapped = lambda k: k in content.fieldNames() and hasattr(content[k].dataType, "fieldNames")
    get = lambda k, kind="string": content_value(F.col(f"content.{k}"), wrapped(k)) if k in content.fieldNames() else F.lit(None).cast(kind)
    names, ids = get("authors", "array<string>"), get("authorids", "array<string>")
    authors = F.transform(F.arrays_zip(names.alias("n"), F.coalesce(ids, F.array().cast("array<string>")).alias("i")), lambda x, p: F.struct(x["i"].alias("id"), x["n"].alias("display_name"), (p + 1).alias("position")))
    day = F.to_date(F.timestamp_millis(_field(raw, "cdate", "bigint").cast("bigint")))
    return raw.select(F.col("id").alias("source_record_id"), get("title").alias("title"), get("abstract").alias("abstract"), authors.alias("authors"), F.year(day).alias("publication_year"), day.cast("string").alias("publication_date"), F.concat(F.lit("https://openreview.net/forum?id="), F.col("id")).alias("landing_url"), F.when(get("pdf").startswith("/"), F.concat(F.lit("https://openreview.net"), get("pdf"))).otherwise(get("pdf")).alias("pdf_url"), get("venue").alias("venue"))


def dblp_hits(raw: DataFrame, year: int | None = None) -> DataFrame:
    """Search hits (``info`` as a JSON string, whose fields may be a string, a list or a mapping) as conference records."""
    text = lambda path: F.coalesce(F.get_json_object("info", f"$.{path}.text"), F.get_json_object("info", f"$.{path}.#text"), F.when(F.get_json_object("info", f"$.{path}").startswith("["), F.array_join(F.from_json(F.get_json_object("info", f"$.{path}"), "array<string>"), ", ")).otherwise(F.get_json_object("info", f"$.{path}")))
    listed = F.get_json_object("info", "$.authors.author")
    several = F.from_json(listed, "array<struct<`@pid`: string, text: string>>")
    one = F.array(F.from_json(listed, "struct<`@pid`: string, text: string>"))
    people = F.when(listed.startswith("["), several).when(listed.startswith("{"), one).otherwise(F.array().cast("array<struct<`@pid`: string, text: string>>"))
    authors = F.transform(people, lambda x, i: F.struct(x["@pid"].alias("id"), F.regexp_replace(x["text"], r" \d{4}$", "").alias("display_name"), (i + 1).alias("position")))
    found = text("year").try_cast("int")
    outside = first_url(F.get_json_object("info", "$.ee"))
    rows = raw.select(F.get_json_object("info", "$.key").alias("source_record_id"), F.rtrim(text("title"), F.lit(".")).alias("title"), found.alias("publication_year"), text("venue").alias("venue"), S.doi_key(text("doi")).alias("doi"), F.coalesce(text("url"), outside).alias("landing_url"), F.when(F.lower(outside).endswith(".pdf"), outside).alias("pdf_url"), authors.alias("authors"))
    return rows.where((F.coalesce("publication_year", F.lit(0)) == 0) | (F.col("publication_year") == year)) if year else rows


def first_url(value: Column) -> Column:
    """First URL of a JSON field that is a string, a mapping (``#text``, ``text`` or ``url``) or a list of these."""
    named = lambda v: F.coalesce(*[F.nullif(F.get_json_object(v, p), F.lit("")) for p in ("$['#text']", "$.text", "$.url")])
    one = lambda v: F.nullif(F.trim(F.when(v.startswith("{"), named(v)).otherwise(v)), F.lit(""))
    listed = F.filter(F.transform(F.from_json(value, "array<string>"), one), lambda u: u.isNotNull())
    return F.when(value.startswith("["), F.get(listed, 0)).otherwise(one(value))


# Venue names of the conference index.
DBLP_VENUES = {
    "aaai": "AAAI", "acl": "ACL", "acm mm": "ACM Multimedia", "chi": "CHI", "cikm": "CIKM", "cvpr": "CVPR", "eccv": "ECCV",
    "emnlp": "EMNLP", "iccv": "ICCV", "iclr": "ICLR", "icml": "ICML", "ijcai": "IJCAI", "kdd": "KDD", "mm": "ACM Multimedia",
    "naacl": "NAACL", "neurips": "NeurIPS", "nips": "NeurIPS", "sigir": "SIGIR", "sigmod": "SIGMOD Conference", "uist": "UIST",
    "www": "WWW",
}
# End of fixed values.


def dblp_query(venue: str, year: int, words: str | None = None) -> str:
    """The index's query for a venue's year, led by the words that are asked for."""
    return " ".join([*([words] if words else []), f"venue:{DBLP_VENUES.get(venue, venue.upper())}:", f"year:{year}:"])


def with_aliases(papers: DataFrame) -> DataFrame:
    """Papers with both names of their citation count, and with ``year``; columns that are there stay as they are."""
    for there, other in (("cited_by_count", "citation_count"), ("citation_count", "cited_by_count"), ("publication_year", "year")):
        if there in papers.columns and other not in papers.columns:
            papers = papers.withColumn(other, F.col(there))
    return papers


def s2_as_openalex(raw: DataFrame) -> DataFrame:
    """Semantic-graph papers with the field names of saved works; the corpus id, else the paper id, is their id."""
    corpus = F.coalesce(_field(raw, "corpusId").cast("string"), _field(raw, "externalIds.CorpusId").cast("string"))
    text = lambda path: F.coalesce(_field(raw, path), F.lit(""))
    count = F.coalesce(_field(raw, "citationCount", "int").cast("int"), F.lit(0))
    year = _field(raw, "year", "int").cast("int")
    people = F.transform(_field(raw, "authors", "array<struct<name: string>>"), lambda a: F.struct(a["name"].alias("display_name")))
    return raw.select(
        F.coalesce(F.nullif(corpus, F.lit("")), text("paperId")).alias("id"), F.lit(None).cast("string").alias("openalex_id"), F.coalesce(corpus, F.lit("")).alias("corpus_id"), text("title").alias("title"), text("abstract").alias("abstract"), year.alias("year"), year.alias("publication_year"),
        _field(raw, "externalIds.DOI").alias("doi"), text("venue").alias("venue"), count.alias("citation_count"), count.alias("cited_by_count"), text("url").alias("url"), F.coalesce(people, F.array().cast("array<struct<display_name: string>>")).alias("authors"), F.lit("semantic_scholar").alias("source"),
    )


def opencitations_count(raw: DataFrame) -> DataFrame:
    """The count that the first row of an answer gives, by ``request``; null where it is no number."""
    return raw.groupBy("request").agg(F.min_by("count", "pos").try_cast("bigint").alias("count"))


def id_batches(ids: DataFrame, size: int = 10, column: str = "id") -> DataFrame:
    """Ids joined by ``__`` in batches of ``size``, as a metadata service is asked for them; a batch never spans partitions."""
    place = Window.partitionBy(F.spark_partition_id()).orderBy(column)
    rows = ids.where(F.col(column) != "").select(column, F.spark_partition_id().alias("part"), F.floor((F.row_number().over(place) - 1) / size).alias("batch"))
    return rows.groupBy("part", "batch").agg(F.array_join(F.array_sort(F.collect_list(column)), "__").alias("ids"), F.count(F.lit(1)).alias("n")).select("ids", "n")


def wos_records(raw: DataFrame) -> DataFrame:
    """Records of either response shape: ``hits``, or ``Data.Records.records.REC``."""
    if "hits" in raw.columns:
        return raw.select(F.explode("hits").alias("r")).select("r.*")
    return raw.select(F.explode("Data.Records.records.REC").alias("r")).select("r.*")


def scopus_entries(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("`search-results`.entry").alias("r")).select("r.*")


def csrankings(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Faculty rows (``name, affiliation, homepage, scholarid``) as homepage records; rows without name or page go."""
    rows = raw.where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("homepage", F.lit(""))) != ""))
    out = rows.select(F.trim("name").alias("scholar_name"), F.trim("homepage").alias("homepage_url"), F.lit("csrankings").alias("source"), "affiliation", S.url_type(F.col("homepage")).alias("url_type"), F.col("scholarid").alias("source_record_id"), F.create_map(F.lit("scholarid"), F.col("scholarid")).alias("extra"))
    return out.limit(limit) if limit else out


def orcid_ids(lines: DataFrame) -> DataFrame:
    """Ids of a text file: blank lines and comments go, URL prefixes too."""
    value = F.trim("value")
    return lines.where((value != "") & ~value.startswith("#")).select(F.regexp_replace(value, r"^https?://orcid\.org/", "").alias("orcid"))


def orcid_profiles(raw: DataFrame) -> DataFrame:
    """Researcher URLs of profiles, with the name and the latest affiliation (by start year, then name)."""
    name = F.coalesce(F.nullif(F.col("person.name.credit-name.value"), F.lit("")), F.nullif(F.concat_ws(" ", F.col("person.name.given-names.value"), F.col("person.name.family-name.value")), F.lit("")))
    groups = F.flatten(F.transform(F.col("`activities-summary`.employments.`affiliation-group`"), lambda g: g["summaries"]))
    jobs = F.transform(groups, lambda s: F.struct(F.coalesce(s["employment-summary"]["start-date"]["year"]["value"].try_cast("int"), F.lit(0)).alias("y"), s["employment-summary"]["organization"]["name"].alias("n")))
    url = F.explode(F.col("person.`researcher-urls`.`researcher-url`"))
    rows = raw.select(F.col("`orcid-identifier`.path").alias("source_record_id"), name.alias("scholar_name"), F.array_max(jobs)["n"].alias("affiliation"), url.alias("u"))
    label = F.lower(F.concat_ws(" ", F.col("u.url-name"), F.col("u.url.value")))
    kind = F.when(label.contains("scholar.google"), "google_scholar").when(label.contains("github"), "github").when(label.contains("linkedin"), "linkedin").when(label.contains("researchgate"), "researchgate").when(label.contains(".edu") | label.contains(".ac."), "institutional").otherwise("personal")
    return rows.select("scholar_name", F.col("u.url.value").alias("homepage_url"), F.lit("orcid").alias("source"), "affiliation", kind.alias("url_type"), "source_record_id")


def conference_source(venue: str, source: str | None = None, collection_id: str | None = None) -> str:
    """Which source serves a venue: as asked, else by the collection id's form, else by venue sets, else DBLP."""
    if source and source != "auto":
        return source
    cid, name = (collection_id or "").lower(), venue.lower()
    if cid.startswith("v") and cid[1:].isdigit():
        return "pmlr"
    for key, prefix in (("openreview", "openreview.net"), ("cvf", "openaccess.thecvf"), ("acl", "aclanthology")):
        if prefix in cid:
            return key
    # Venues of each source.
    sets = {"openreview": {"iclr", "neurips", "colm", "tmlr"}, "acl": {"acl", "emnlp", "naacl", "eacl", "aacl", "coling", "conll", "findings", "tacl"}, "cvf": {"cvpr", "iccv", "wacv"}, "pmlr": {"icml", "aistats", "corl", "colt", "uai"}}
    # End of fixed values.
    return next((key for key, names in sets.items() if name in names), "dblp")
