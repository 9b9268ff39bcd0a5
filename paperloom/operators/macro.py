"""Countries and institutions: full or fractional counts, density, corresponding authors, collaboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.functions import text as T
from paperloom.functions.scalars import count
from paperloom.model.tables import Tables


def _per_work(t: Tables, key: str) -> DataFrame:
    """Sorted distinct keys of each work; of each key the attributes of its last listing."""
    listed = t.institutions.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return listed.groupBy("work_id").agg(F.array_sort(F.collect_set(key)).alias("keys"))


def _weighted(t: Tables, key: str, counting: str) -> DataFrame:
    sets = _per_work(t, key).join(t.works.select("work_id", "citations", "year", "pos"), "work_id")
    return sets.select("work_id", "citations", "year", "pos", S.counting_weight(F.size("keys"), counting).alias("weight"), F.size("keys").alias("n"), F.explode("keys").alias(key))


def edges(t: Tables, key: str, top: int = 150, min_weight: int = 1) -> DataFrame:
    """Pairs that share works. Pairs are made inside each work's own set, so no join is needed."""
    made = _per_work(t, key).select(F.explode(T.pairs(F.col("keys"))).alias("p")).select("p.source", "p.target")
    return made.groupBy("source", "target").agg(count().alias("weight")).where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "source", "target").limit(top)


def _collaborators(t: Tables, key: str) -> DataFrame:
    """Occurrences of links of each key: with n keys in a work each has n - 1."""
    return _per_work(t, key).select(F.explode("keys").alias(key), (F.size("keys") - 1).cast("bigint").alias("links")).groupBy(key).agg(F.sum("links").alias("collaborator_count"))


def countries(t: Tables, counting: str = "full", top: int = 30, min_count: float = 1) -> DataFrame:
    rows = _weighted(t, "country_code", counting)
    stats = rows.groupBy("country_code").agg(F.sum("weight").alias("n_papers"), F.sum(F.col("citations") * F.col("weight")).alias("total_citations"), F.min_by("year", F.struct("pos")).alias("first_year"), F.max_by("year", F.struct("pos")).alias("last_year"))
    stats = stats.where(F.col("n_papers") >= min_count).join(_collaborators(t, "country_code"), "country_code", "left")
    out = stats.select("country_code", "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"), "first_year", "last_year", F.coalesce("collaborator_count", F.lit(0)).alias("collaborator_count"))
    return out.orderBy(F.desc("n_papers"), F.desc("total_citations"), "country_code").limit(top)


def institutions(t: Tables, counting: str = "full", top: int = 30, min_count: float = 1) -> DataFrame:
    """Names, countries and types are those of the last listing."""
    rows = _weighted(t, "institution_id", counting)
    stats = rows.groupBy("institution_id").agg(F.sum("weight").alias("n_papers"), F.sum(F.col("citations") * F.col("weight")).alias("total_citations"), F.min_by("year", F.struct("pos")).alias("first_year"), F.max_by("year", F.struct("pos")).alias("last_year"))
    listed = t.institutions.join(t.works.select("work_id", "pos"), "work_id").where("institution_id is not null")
    names = listed.groupBy("institution_id").agg(F.max_by(F.struct("institution", "country_code", "institution_type"), F.struct("pos", "apos", "ipos")).alias("x"))
    out = stats.where(F.col("n_papers") >= min_count).join(names, "institution_id").join(_collaborators(t, "institution_id"), "institution_id", "left")
    out = out.select(
        F.col("institution_id").alias("id"), F.col("x.institution").alias("name"), F.col("x.country_code").alias("country_code"), F.col("x.institution_type").alias("type"), "n_papers", "total_citations", (F.col("total_citations") / F.col("n_papers")).alias("avg_citations"),
        "first_year", "last_year", F.coalesce("collaborator_count", F.lit(0)).alias("collaborator_count"),
    )
    return out.orderBy(F.desc("n_papers"), F.desc("total_citations"), "id").limit(top)


def density(t: Tables, counting: str = "full") -> DataFrame:
    """Distinct institutions of each country and the papers they weigh."""
    rows = _weighted(t, "institution_id", counting).select("work_id", "institution_id", "weight")
    home = t.institutions.select("work_id", "institution_id", "country_code").where("country_code <> ''").distinct()
    return rows.join(home, ["work_id", "institution_id"]).groupBy("country_code").agg(F.count_distinct("institution_id").alias("n_institutions"), F.sum("weight").alias("n_papers"))


def country_by_year(t: Tables) -> DataFrame:
    return _weighted(t, "country_code", "full").where("year is not null").groupBy("year", "country_code").agg(count().alias("n_papers"))


def institution_by_year(t: Tables) -> DataFrame:
    return _weighted(t, "institution_id", "full").where("year is not null").groupBy("year", "institution_id").agg(count().alias("n_papers"))


def pivot(rows: DataFrame, index: str, columns: str, values: str, known: list[str] | None = None) -> DataFrame:
    """Wide matrix, 0 where nothing was counted. With ``known`` columns no extra pass finds them."""
    return rows.groupBy(index).pivot(columns, known).agg(F.sum(values)).na.fill(0).orderBy(index)


def corresponding(t: Tables, top: int = 30) -> DataFrame:
    """Single and multiple country papers by the corresponding author's country (else the first author's, else the only one)."""
    listed = t.institutions.where("country_code <> ''").join(t.authorships.select("work_id", "apos", "is_corresponding"), ["work_id", "apos"], "left")
    chosen = lambda test: F.collect_set(F.when(test, F.col("country_code")))
    sets = listed.groupBy("work_id").agg(chosen(F.col("is_corresponding").eqNullSafe(True)).alias("c"), chosen(F.col("apos") == 1).alias("f"), F.collect_set("country_code").alias("k"))
    only = F.when(F.size("k") == 1, F.col("k")).otherwise(F.array().cast("array<string>"))
    rows = sets.select(F.size("k").alias("n"), F.explode(S.first_truthy("c", "f", only, kind="array")).alias("country_code"))
    many = F.count_if(F.col("n") > 1)
    out = rows.groupBy("country_code").agg(F.count_if(F.col("n") <= 1).alias("scp"), many.alias("mcp"), count().alias("total"))
    return out.withColumn("mcp_share", F.col("mcp") / F.col("total")).orderBy(F.desc("total"), "country_code").limit(top)


def unpivot_corresponding(rows: DataFrame) -> DataFrame:
    """Two rows for each country, as a stacked chart wants them."""
    return rows.unpivot(["country_code"], ["scp", "mcp"], "kind", "papers")


def overview(t: Tables) -> DataFrame:
    """Works with one or several countries and institutions, and shares of those that name any."""
    per_work = t.institutions.groupBy("work_id").agg(F.count_distinct(F.nullif("country_code", F.lit(""))).alias("c"), F.count_distinct("institution_id").alias("i"))
    n: dict[str, Column] = {"single_country": F.col("c") == 1, "multi_country": F.col("c") > 1, "single_institution": F.col("i") == 1, "multi_institution": F.col("i") > 1}
    row = per_work.where("c > 0 or i > 0").agg(count().alias("records_with_institutions"), *[F.count_if(test).alias(k) for k, test in n.items()])
    return row.select("*", (F.col("multi_country") / F.col("records_with_institutions")).alias("multi_country_share"))


def node_weights(rows: DataFrame) -> DataFrame:
    """Degree and weight of each endpoint of an edge table."""
    ends = rows.select(F.explode(F.array("source", "target")).alias("node"), "weight")
    return ends.groupBy("node").agg(count().alias("degree"), F.sum("weight").alias("weighted_degree"))


def pruned_nodes(rows: DataFrame, papers: DataFrame, keep: int = 36) -> DataFrame:
    """Nodes of a drawing: score 2 * papers + strength + 0.35 * degree, the best ``keep``; nodes without an edge are out."""
    scored = node_weights(rows).join(papers, "node", "left").withColumn("score", 2 * F.coalesce("n_papers", F.lit(0.0)) + F.col("weighted_degree") + 0.35 * F.col("degree"))
    return scored.orderBy(F.desc("score"), "node").limit(keep)


def country_table(spark: SparkSession) -> DataFrame:
    """``key, iso3, name`` of the ISO 3166 countries that the JVM knows, two rows for each (by its two and its three letters);
    names are the JVM's English ones. About 500 rows."""
    locale = spark.sparkContext._jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        here = locale("", code)
        rows += [(key, here.getISO3Country(), here.getDisplayCountry(locale.ENGLISH)) for key in (code, here.getISO3Country())]
    return spark.createDataFrame(rows, "key string, iso3 string, name string")


def with_countries(rows: DataFrame, code: str = "country_code") -> DataFrame:
    """Rows with ``country_iso3`` and ``country_name`` behind their code. A code of three letters is its own ISO3; an unknown
    one has an empty ISO3 and itself as its name; a null or empty code has two empty ones."""
    known = F.broadcast(country_table(rows.sparkSession))
    own = F.coalesce(F.col(code), F.lit(""))
    found = rows.join(known, F.upper(own) == F.col("key"), "left")
    iso3 = F.when(F.length(own) == 3, F.upper(own)).otherwise(F.coalesce("iso3", F.lit("")))
    at = rows.columns.index(code) + 1
    return found.select(*rows.columns[:at], iso3.alias("country_iso3"), F.coalesce("name", own).alias("country_name"), *rows.columns[at:])
