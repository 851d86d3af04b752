"""Files and databases: typed CSV with a check of its columns, lenient CSV, zone JSON, partitioned tables that grow by what they lack, JDBC."""

from __future__ import annotations

import atexit
import json
import os
import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or a temporary one in local mode where that is unset. It goes
    with the session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="huegrain-"))
        root = f"file://{_OWN[0]}"
    path = f"{root.rstrip('/')}/huegrain/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target, fs = _path(spark, path)
        fs.delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def stamped(root: str, name: str, stamp: str) -> str:
    """An output folder of one run: ``stamp`` is its time as yyyymmdd_hhmmss."""
    if not re.fullmatch(r"\d{8}_\d{6}", stamp):
        raise ValueError(f"{stamp} is no time of the form yyyymmdd_hhmmss")
    return f"{root.rstrip('/')}/{name}_{stamp}"


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header as ``schema`` types it. Columns may come in any order and there may be more; an absent one is an error,
    and so is a value that its type does not hold."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [tuple(x.split()) for x in schema.split(",")]
    if missing := [name for name, _ in wanted if name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw.select(*(F.col(name).cast(kind).alias(name) for name, kind in wanted))


def read_csv_lenient(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> DataFrame:
    """The same, but what its type does not hold is null; rows without a required value, or whose ``positive`` value is 0 or less, go."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [tuple(x.split()) for x in schema.split(",")]
    if missing := [name for name, _ in wanted if name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    rows = raw.select(*(F.expr(f"try_cast(`{name}` AS {kind}) AS `{name}`") for name, kind in wanted))
    for name in required:
        rows = rows.filter(F.col(name).isNotNull())
    for name in positive:
        rows = rows.filter(~F.coalesce(F.col(name) <= 0, F.lit(False)))
    return rows


def missing(df: DataFrame, path: str, by: str | list[str]) -> DataFrame:
    """The rows of those values of ``by`` that the table at ``path`` does not hold; all where there is no table yet. No value is null."""
    if not exists(df.sparkSession, path):
        return df
    return df.join(df.sparkSession.read.parquet(path).select(by).distinct(), by, "left_anti").select(*df.columns)


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; without rows where nothing was appended yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_missing(df: DataFrame, path: str, by: str | list[str], partition: str | None = None) -> int:
    """Append the rows of those values of ``by`` that the table at ``path`` does not hold yet; their number of values. An append is
    committed whole or not at all, so a run that was cut off is made good by the next one."""
    df = missing(df, path, by)
    fresh = df.select(by).distinct().count()
    if fresh:
        rows = df.repartition(F.col(partition)).write.partitionBy(partition) if partition else df.write
        rows.mode("append").parquet(path)
    return fresh


def write_zones(zones: DataFrame, path: str, stamp: str, overwrite: bool = False) -> str:
    """Zones (name, cluster_ids) as JSON lines; returns where. A file that is there may hold edits by hand: it is left alone, and the new
    zones go beside it under the run's stamp, unless ``overwrite``."""
    if exists(zones.sparkSession, path) and not overwrite:
        path = f"{path}.{stamp}"
    zones.select("name", "cluster_ids").write.mode("overwrite").json(path)
    return path


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """(zone, cluster_id) of a zone file; names of the form Group N are shown as Zone N."""
    rows = spark.read.schema("name string, cluster_ids array<bigint>").json(path)
    return rows.select(F.regexp_replace("name", "^Group ", "Zone ").alias("zone"), F.explode("cluster_ids").alias("cluster_id"))


def jdbc_options(brand: str, environment: Mapping[str, str] = os.environ, write: bool = False) -> dict[str, str]:
    """Options of a brand's database from DB_HOST, DB_PORT, DB_USER and DB_PASSWORD; a session reads only unless ``write``."""
    host, port = environment.get("DB_HOST", "localhost"), environment.get("DB_PORT", "5432")
    options = {"url": f"jdbc:postgresql://{host}:{int(port)}/{brand}", "user": environment.get("DB_USER", ""), "password": environment.get("DB_PASSWORD", ""), "driver": "org.postgresql.Driver", "fetchsize": "10000"}
    return options if write else options | {"sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"}


def read_table(spark: SparkSession, brand: str, table: str, key: str, bounds: tuple[int, int], parts: int = 16, environment: Mapping[str, str] = os.environ) -> DataFrame:
    """A table of a brand's database, read by ranges of ``key`` in as many connections as ``parts``."""
    reader = spark.read.format("jdbc").options(**jdbc_options(brand, environment)).option("dbtable", table)
    return reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts)).load()


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(term, decision) of a review's JSON object; an empty table where none was written."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string, decision string")
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # written by hand, one entry a term
    return spark.createDataFrame(sorted(json.loads(text).items()), "term string, decision string")


def handed_on(df: DataFrame) -> DataFrame:
    """``df`` written to a workspace and read back: lineage ends there, and a lost executor repeats nothing before it. Goes with the session
    or by ``release``."""
    path = workspace(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``handed_on`` that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._written)


def changed(spark: SparkSession, path: str) -> tuple[str, int]:
    """A file's or folder's path and the time of its last change."""
    target, fs = _path(spark, path)
    return path, fs.getFileStatus(target).getModificationTime()


_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, paths: list[str], build):
    """What ``build`` gives, a written table or several, made once a session for the same state of the files at ``paths``."""
    key = (spark.sparkContext.applicationId, name, *(changed(spark, path) for path in paths))
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]
