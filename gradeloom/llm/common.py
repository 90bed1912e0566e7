"""Small helpers shared by the operators: written intermediate tables and per-worker state."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a plain local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gradeloom-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SCOPES: list[list[Scratch]] = []


class Scratch:
    """Tables that one operator call writes under the shared folder.

    Writing cuts the lineage on storage that outlives every executor, and later readers see the
    table's true size. ``drop`` removes a table that no later step reads, ``scratch_scope`` all
    tables of the calls inside it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.base = f"{shared_root(spark)}/llm/{app}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        if _SCOPES:
            _SCOPES[-1].append(self)

    def write(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """``df`` as a table. With ``free`` Spark deletes the job's shuffle files when it is over,
        so ``df`` itself is computed anew if it is read again."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        if free:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if free:
                self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._alive = getattr(self, "_alive", []) + [out]
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Remove every table of this call; frames that still read one become unusable."""
        self.paths.clear()
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Remove what operators called inside wrote to scratch; write their results before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.clear()


def worker_state(key: str, build: Callable[[], object]) -> object:
    """One object per Python worker and key, kept over tasks (functions are shipped by value)."""
    home = sys.modules.setdefault("_gradeloom_worker", types.ModuleType("_gradeloom_worker"))
    found = home.__dict__.get(key)
    if found is None:
        found = home.__dict__[key] = build()
    return found


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so once the driver has collected their plans, which may take long by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


# pandas turns integers with nulls into doubles, which would round large ids: a null id visits
# Python as the smallest integer.
NO_ID = -2**63


def shown_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID)).alias(name)


def hidden_id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
