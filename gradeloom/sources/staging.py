"""Intermediate tables in the cluster's shared folder.

A staged table does three jobs: work that several steps need is done once, lineage is cut on
storage that outlives any executor, and the planner sees the table's true size. The last
point is why no module of this package gives a broadcast hint: a small staged table is under
``spark.sql.autoBroadcastJoinThreshold`` and gets broadcast, a large one gets a shuffled join
with adaptive skew handling. Lookups are written as left joins: only the looked-up side can
then be broadcast, and the rows keep their partitioning.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
# Tables of the catalog by the folder that holds them.
_TABLES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; plain local masters without one get a temporary
    folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gradeloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables; others under the same root are not ours."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{staged_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and hand back a scan of the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """``df`` staged in buckets of ``keys``, one file each and as many as shuffle partitions.

    A plain staged table forgets how its rows were dealt out. A bucketed one is read as it was
    written, so joins with its like and groups by ``keys`` (or by them and more) need no exchange.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = "staged_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option(
        "path", path).saveAsTable(name)
    _TABLES[path] = name
    return spark.table(name)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Stage a table about to be looked up, unless the planner's own bound already says small.

    Estimates only shrink by what the planner can prove, so a table derived from large input
    counts as large until it is written and its true size is known.
    """
    bound, size = _planner_sizes(df)
    return df if size <= bound else stage(df, label)


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside when it ends; write results before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def clear_staged(spark: SparkSession) -> None:
    """Delete every table this application staged; frames that still read them become unusable."""
    root = staged_dir(spark)
    for path in [p for p in _TABLES if p.startswith(f"{root}/")]:
        _delete(spark, path)
    _delete(spark, root)


# The steps below have no public form; they need a classic session.


def _planner_sizes(df: DataFrame) -> tuple[int, int]:
    bound = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return bound, planner_bytes(df)


def planner_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: that of its files for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def _delete(spark: SparkSession, path: str) -> None:
    name = _TABLES.pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
