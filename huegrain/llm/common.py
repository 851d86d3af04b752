"""Shared plumbing of the text operators: hand-off tables, Arrow batches, seeded hashes."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode (tests), and
    an error on a cluster, whose executors would each write to a disk of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="huegrain-"))
    return f"file://{_OWN_DIR[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _writer(df: DataFrame, name: str, write) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/huegrain/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        write(df.write.option("compression", "zstd"), path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    atexit.register(_remove, spark, path)
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    return path


_SCRATCH: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch():
    """Tables written inside are deleted at the end, but for those that go through the function that this gives: they belong to the scope
    around it. What is kept must not read the others any more: it is a written table itself."""
    held: list[tuple[SparkSession, str]] = []
    _SCRATCH.append(held)

    def keep(table: DataFrame) -> DataFrame:
        mine = (table.sparkSession, table._written)
        held.remove(mine)
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(mine)
        return table

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for spark, path in held:
            _remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there,
    a lost executor recomputes nothing before it, and a join on it gets a fresh (splittable) exchange.
    The shuffle files of the write go with its end, since nothing reads them again."""
    path = _writer(df, name, lambda to, path: to.parquet(path))
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``materialize``, as a table bucketed by ``key``: a join or aggregation by it moves only what it is joined with."""
    spark, table = df.sparkSession, f"huegrain_{name}_{uuid.uuid4().hex}"
    path = _writer(df, name, lambda to, path: to.bucketBy(shuffle_width(spark), key).sortBy(key).option("path", path).saveAsTable(table, format="parquet"))
    atexit.register(_forget, spark, table)
    found = spark.table(table)
    found._written = path
    return found


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session is gone, and the name with it
        pass


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no unwritten DataFrame reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._written)


def doc_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding about ``max_bytes`` of text each, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray([0 if n is None else n for n in pc.binary_length(column).to_pylist()], np.int64)
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start:])
            stop = start + max(1, int(np.searchsorted(total, max_bytes)))
            part = batch.slice(start, stop - start)
            yield part, [t or b"" for t in part.column(batch.schema.get_field_index(text)).to_pylist()]
            start = stop


def text_input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator reads, under fixed names; the text as bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, vectorised."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A bounded memo: ``fill`` computes a missing value; when full, it starts anew."""

    def __init__(self, fill, limit: int = 400_000):
        super().__init__()
        self._fill, self._limit = fill, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        self[key] = value = self._fill(key)
        return value


def in_one_task(sample: DataFrame, fit, order: str = "doc_id"):
    """``fit`` over the rows (dicts) of a sample of bounded size, run on an executor: neither the driver's memory nor its
    time grows with a model's training, and a lost executor only repeats the task. Returns what ``fit`` returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions(order).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])
