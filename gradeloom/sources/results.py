"""Result tables: one row per prompt, model and metric, one folder per run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH-mm-ss")


def append_results(results: DataFrame, path: str, fmt: str = "parquet",
                   run_id: str | None = None) -> str:
    """Add ``prompt, model, metric, value`` rows, rounded to 4 decimals, and return the run's id.

    A run is the folder ``run_id=...`` and its time is the column ``run_ts``, so runs of one second
    stay apart. Writing replaces this run's folder and no other when the job commits: an append
    that is repeated under its id leaves one copy, and one that fails half-way leaves the table as
    it was. A run without rows adds nothing. The few rows are gathered after a shuffle, so the
    steps that make them keep their tasks.
    """
    run_id = run_id or uuid.uuid4().hex
    rows = results.withColumn("value", F.round("value", 4)).withColumn(
        "run_ts", run_stamp()).withColumn("run_id", F.lit(run_id))
    (rows.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").format(fmt).save(path))
    return run_id
