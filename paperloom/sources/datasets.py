"""Saved collections: reading, describing, writing. Data goes through Spark's readers and writers; only small JSON is driver text."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.model import schema

DATA_FILES = ("papers.json", "authors.json", "data.json")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


@dataclass(frozen=True)
class Collection:
    """A saved collection: its rows, its metadata, and where it lies."""

    rows: DataFrame
    path: str
    metadata: dict = field(default_factory=dict)

    def info(self) -> dict:
        return {"path": self.path, "schema_name": self.metadata.get("schema_name", "works"), "records": self.rows.count(), "metadata": self.metadata.get("metadata", {}), "diagnostics": self.metadata.get("diagnostics", [])}


def load(spark: SparkSession, path: str, columns: str = schema.WORK) -> Collection:
    """A data file, a Parquet folder, or a folder with ``metadata.json`` (or a data file of a known name)."""
    metadata: dict = {}
    data = path
    if not path.endswith((".json", ".jsonl", ".parquet")):
        if exists(spark, f"{path}/metadata.json"):
            metadata = json.loads(_read_text(spark, f"{path}/metadata.json"))
        name = metadata.get("data_file") or next((n for n in (*DATA_FILES, "data.parquet") if exists(spark, f"{path}/{n}")), None)
        if name is None:
            raise FileNotFoundError(f"no data file in {path}")
        data = f"{path}/{name}"
    if data.endswith(".parquet"):
        return Collection(spark.read.parquet(data), path, metadata)
    lines = data.endswith(".jsonl")
    # Rows that aren't records (none of their first columns is set) are dropped, as is what doesn't parse.
    rows = spark.read.schema(f"{columns}, _corrupt_record string").json(data, multiLine=not lines, mode="PERMISSIVE")
    some = F.coalesce(*[F.col(c).cast("string") for c in rows.columns[:3]])
    kept = rows.where(some.isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return Collection(kept, path, metadata)


def directory_name(kind: str, request: dict) -> str:
    """Stable name: kind, a slug of the request, and twelve digits of its hash."""
    text = json.dumps(request, sort_keys=True, ensure_ascii=False, default=str)
    words = str(request.get("query") or request.get("venue") or request.get("name") or kind)
    slug = re.sub(r"[^a-z0-9]+", "-", words.lower()).strip("-")[:48] or kind
    return f"{kind}_{slug}_{hashlib.sha1(text.encode()).hexdigest()[:12]}"


def save(rows: DataFrame, root: str, kind: str, command: str, request: dict, metadata: dict | None = None, diagnostics: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write a collection's data and metadata; the folder's path comes back."""
    spark, path = rows.sparkSession, f"{root}/{directory_name(kind, request)}"
    data = f"data.{'parquet' if fmt == 'parquet' else 'jsonl'}"
    writer = rows.write.mode("overwrite")
    writer.parquet(f"{path}/{data}") if fmt == "parquet" else writer.json(f"{path}/{data}")
    _write_text(spark, f"{path}/metadata.json", json.dumps({"schema_name": kind, "command": command, "input": request, "metadata": metadata or {}, "diagnostics": diagnostics or [], "data_file": data}, indent=1, default=str))
    return path


def as_table(spark: SparkSession, value: object) -> DataFrame:
    """A result as a table: DataFrames as they are, a list of mappings as rows, a mapping as one row, anything else as one
    ``value``. Fields that a row lacks are null; an empty list has no rows and no columns."""
    if isinstance(value, DataFrame):
        return value
    rows = value if isinstance(value, list) else [value] if isinstance(value, dict) else [{"value": value}]
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        return spark.createDataFrame([], "struct<>")
    empty = [n for n in names if all(r.get(n) is None for r in rows)]
    table = spark.createDataFrame([tuple("" if n in empty else r.get(n) for n in names) for r in rows], names)
    return table.withColumns({n: F.lit(None).cast("string") for n in empty})


def save_analysis(spark: SparkSession, path: str, tables: dict[str, DataFrame], summary: str = "", diagnostics: list[str] | None = None) -> dict[str, str]:
    """One CSV for each table (nested columns as JSON), a Markdown summary and the list of what was written."""
    files = {}
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes])
        flat.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)  # result tables are small by their limits
        files[name] = f"{path}/{name}.csv"
    _write_text(spark, f"{path}/summary.md", summary)
    _write_text(spark, f"{path}/analysis.json", json.dumps({"tables": files, "diagnostics": diagnostics or []}, indent=1))
    return files | {"summary": f"{path}/summary.md", "analysis": f"{path}/analysis.json"}


def save_homepages(rows: DataFrame, path: str, fmt: str = "jsonl") -> None:
    writer = rows.withColumn("extra", F.to_json("extra")).write.mode("overwrite").option("header", True) if fmt == "csv" and "extra" in rows.columns else rows.write.mode("overwrite")
    writer.csv(path) if fmt == "csv" else writer.json(path)
