"""Shared pieces: tables in the shared folder, text access in Arrow batches, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import paperloom
from paperloom.operators.graph import star_forest
from paperloom.session import table

__all__ = ["Workspace", "arrow_groups", "arrow_map", "bucket_of", "buckets_of", "checkpoint_dir", "components", "flag_possible", "packed", "possibly_in", "table", "text_bytes", "unpacked"]

#: Functions of this package are shipped by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(paperloom)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set and Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="paperloom-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Frees a query's shuffle files as soon as it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For tables in a local folder: Hadoop's usual file system starts a ``chmod`` process for each file and one more for its checksums,
#: each of which shares the whole memory of the JVM until it has begun. The plain one writes no checksum files.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Workspace:
    """Parquet tables in the shared folder. They cut lineage and survive the loss of executors.

    ``drop`` deletes a table once nothing will read it; tables that a lazy result still needs go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/paperloom-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        # Once the table is there nothing reads the shuffles behind it; they would stay on the executors' disks otherwise.
        before = self.spark.conf.get(FREE, "false")
        self.spark.conf.set(FREE, "true")
        try:
            df.write.options(**PLAIN).option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(FREE, before)
        # The schema is given: without it an empty table's read would have to infer one.
        back = self.spark.read.schema(df.schema).parquet(path)
        back._paperloom_path = path
        return back

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            self._delete(df._paperloom_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def arrow_map(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """Map only ``columns`` of ``df`` with a function made once for each task; it turns a batch into dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_groups(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.Table], Iterator[dict]]) -> DataFrame:
    """What ``work`` makes of all rows of a ``bucket``, as dicts of columns; those that it leaves out are null."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(rows: pa.Table) -> pa.Table:
        batches = []
        for out in work(rows):
            n = len(next(iter(out.values())))
            batches.append(pa.RecordBatch.from_arrays([_array(out[f.name], f.type) if f.name in out else pa.nulls(n, f.type) for f in target], schema=target))
        return pa.Table.from_batches(batches, schema=target)

    return df.select("bucket", *columns).groupBy("bucket").applyInArrow(run, schema)


def buckets_of(spark: SparkSession) -> int:
    """Buckets among which packed records are dealt: as many as a shuffle has partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)


def packed(name: str, bucket: np.ndarray, *columns: np.ndarray) -> dict:
    """Records, given by columns, as one binary value for each bucket: its part of each column, one after another. A shuffle
    then moves few values instead of many rows."""
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]]) if len(dealt) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    return {"bucket": dealt[cuts[:-1]], name: [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]}


def unpacked(column: pa.ChunkedArray, kinds: str) -> list[np.ndarray]:
    """The columns of all packed records; ``kinds`` names their numpy types."""
    types = [np.dtype(k) for k in kinds.split()]
    size, parts = sum(t.itemsize for t in types), [[np.empty(0, t)] for t in types]
    for value in column:
        if value.is_valid:
            raw, at = value.as_buffer(), 0
            n = len(raw) // size
            for part, t in zip(parts, types, strict=True):
                part.append(np.frombuffer(raw, t, n, at))
                at += n * t.itemsize
    return [np.concatenate(part) for part in parts]


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each node that has an edge to another (bigint columns ``u``, ``v``): columns ``node``,
    ``component``. Every round is written to the shared folder; the loop ends when nothing is left to move."""
    return star_forest(edges, space.write, space.drop)


def flag_possible(df: DataFrame, column: str, keys: DataFrame, key: str, flag: str, most_blocks: int = 1 << 17) -> DataFrame:
    """``df`` with a boolean ``flag``: whether ``column`` may be among ``keys`` (never false for one that is).

    The blocked Bloom filter that goes to all executors has at most ``most_blocks`` rows (5 MB), whatever the number of keys.
    """
    n = keys.count()
    blocks = min(most_blocks, max(16, 1 << (n // 16).bit_length()))
    mask = lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit(i)), F.lit(64)).cast("int"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    words = keys.select(block(F.col(key)).alias(f"{flag}_block"), *[mask(F.col(key), i).alias(f"{flag}{i}") for i in range(4)])
    words = words.groupBy(f"{flag}_block").agg(*[F.bit_or(f"{flag}{i}").alias(f"{flag}{i}") for i in range(4)])
    found = df.join(F.broadcast(words), block(F.col(column)) == F.col(f"{flag}_block"), "left")
    passes = F.col(column).isNotNull()
    for i in range(4):
        passes = passes & (F.col(f"{flag}{i}").bitwiseAND(mask(F.col(column), i)) == mask(F.col(column), i))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(passes, F.lit(False)).alias(flag))


def possibly_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys``."""
    return flag_possible(df, column, keys, key, "_possible").where("_possible").drop("_possible")
