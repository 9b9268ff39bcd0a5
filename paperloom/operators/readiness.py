"""Readiness of a collection for each analysis, and the parameters that follow from its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.model.tables import Tables

FIELDS = ("title", "abstract", "year", "authors", "author_institutions", "source", "topics", "referenced_works")
#: For each tool its checks: field, share of records it needs; and what to fetch where they are missing.
CHECKS = {
    "bibliometrics": ([("title", 0.8, "titles"), ("year", 0.5, "publication years"), ("source", 0.5, "sources"), ("authors", 0.5, "authors")], ["authors"]),
    "macro": ([("authors", 0.5, "authors"), ("author_institutions", 0.5, "author institutions")], ["authors"]),
    "author_landscape": ([("authors", 0.5, "authors")], ["authors"]),
    "coword": ([("title_or_abstract", 0.8, "titles or abstracts")], []),
    "topic_landscape": ([("topics", 0.3, "topics"), ("title_or_abstract", 0.8, "titles or abstracts")], []),
    "topic_modeling": ([("title_or_abstract", 0.8, "titles or abstracts")], []),
    "citation_overview": ([("referenced_works", 0.5, "referenced works")], ["references"]),
}


def _counts(t: Tables) -> DataFrame:
    having = lambda rows, name: rows.select("work_id", F.lit(True).alias(name)).distinct()
    works = t.works
    for rows, name in ((t.authorships, "_a"), (t.institutions, "_i"), (t.topics, "_t"), (t.refs, "_r")):
        works = works.join(having(rows, name), "work_id", "left")
    test = {"title": F.col("title") != "", "abstract": F.col("abstract") != "", "year": F.col("year").isNotNull(), "authors": F.col("_a"), "author_institutions": F.col("_i"), "source": F.col("source_name") != "", "topics": F.col("_t"), "referenced_works": F.col("_r")}
    return works.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(test[f], F.lit(False))).alias(f) for f in FIELDS])


def coverage(t: Tables) -> DataFrame:
    """Records that have each field, and their share in percent: one pass, then turned on its side."""
    rows = _counts(t).unpivot(["total"], list(FIELDS), "field", "records")
    return rows.select("field", "records", F.when(F.col("total") > 0, F.col("records") / F.col("total") * 100).otherwise(0.0).alias("coverage"))


def tool_status(t: Tables) -> list[dict]:
    """Status and message of each tool, from the one row of counts."""
    row = _counts(t).first().asDict()
    row["title_or_abstract"] = max(row["title"], row["abstract"])
    out = []
    for tool, (checks, include) in CHECKS.items():
        missing = [label for field, _, label in checks if not row[field]]
        low = [f"low {label} coverage ({round(row[field] / row['total'] * 100, 1)}%)" for field, least, label in checks if row[field] and row[field] / row["total"] < least]
        status = "missing" if missing else "warning" if low else "ready"
        message = f"Missing {', '.join(missing)}" if missing else "; ".join(low) or "Ready"
        out.append({"tool": f"analysis.{tool}", "status": status, "message": message, "recommended_fetch_args": {"include": include} if include else {}})
    return out


def safe_defaults(n: int) -> dict[str, int | None]:
    """Parameters by the number of records."""
    return {"min_count": 1 if n < 100 else 2, "nr_topics": 2 if n < 20 else None, "max_docs": 2000 if n > 2000 else None, "min_papers": 1 if n < 500 else 2}


def preflight(t: Tables) -> dict:
    """What can run, with which parameters, and what to fetch for the rest."""
    tools = tool_status(t)
    include = sorted({i for x in tools for i in x["recommended_fetch_args"].get("include", [])})
    row = _counts(t).first()
    text, topics = max(row["title"], row["abstract"]), row["topics"]
    methods = [*(["openalex_topics"] if topics else []), *(["coword", "topic_modeling"] if text else [])]
    return {"recommended": [x["tool"] for x in tools if x["status"] == "ready"], "blocked": [x["tool"] for x in tools if x["status"] == "missing"], "safe_defaults": safe_defaults(row["total"]), "topic_landscape_methods": methods, "recommended_fetch_args": {"include": include} if include else {}, "tools": tools}


def qa_summary(t: Tables) -> DataFrame:
    """Per-fetch figures: records, years, missing DOIs, authorships without an institution."""
    with_home = t.authorships.join(t.institutions.select("work_id", "apos").distinct(), ["work_id", "apos"], "left_anti").agg(F.count(F.lit(1)).alias("authorships_without_institution"))
    row = t.works.agg(F.count(F.lit(1)).alias("n_works"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.coalesce("doi", F.lit("")) == "").alias("missing_doi"), F.count_distinct("type").alias("n_types"))
    return row.crossJoin(F.broadcast(with_home)).crossJoin(F.broadcast(t.authorships.agg(F.count(F.lit(1)).alias("n_authorships"))))  # one row each
