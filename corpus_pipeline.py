"""A training-data pipeline over ``documents``: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. Rows are kept or dropped whole;
the fourth stage replaces personal data in ``text`` (and sets ``n_chars`` anew where that column exists). A null text is
clean, unique, uncontaminated and free of personal data, and is packed as an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, near_duplicates, packing, pii, toxicity
from paperloom.llm.common import Workspace, flag_possible, table
from paperloom.llm.queries import tokenizer_path

#: Documents that score this much or more are rejected.
TOXIC = 0.7


def _free(prefix: str, docs: DataFrame) -> str:
    """A column prefix that no column of ``docs`` starts with."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    return prefix


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field doesn't reject."""
    own = _free("_toxic", docs)
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=docs.columns, score_col=f"{own}_score", spans_col=f"{own}_spans")
    return scored.where(F.col(f"{own}_score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Rows with a null id belong to no group."""
    space = Workspace(spark, "kept")
    found = space.write(near_duplicates.near_duplicates(docs.select("doc_id", "text")), "found")
    dropped = space.write(found.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    odd = space.write(dropped.unionByName(repeated).distinct(), "odd")
    # Only documents that may be dropped or repeated are shuffled; all others stay where they are.
    own = _free("_odd", docs)
    flagged = flag_possible(docs, "doc_id", odd, "doc_id", own)
    clear = flagged.where(~F.col(own)).select(*docs.columns)
    doubtful = flagged.where(own).select(*docs.columns).join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # Repeated rows: the same id with the same text stays once.
    return clear.unionByName(doubtful.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    own = _free("_bench_", docs)
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, prefix=own)
    return judged.where(~decontaminate.contaminated(own)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind in brackets."""
    redacted = pii.find_pii(docs, keep=docs.columns, redact=True)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        redacted = redacted.withColumn("n_chars", F.length("text").cast(kind))
    return redacted.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and tokenizers aren't SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
