"""Incremental weekly series of a stream of judged commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.tally import counted
from ..schema import KINDS


def weekly(results: DataFrame, late: str = "14 days") -> DataFrame:
    """Sums by week (Monday, UTC) over a stream; a week closes ``late`` after the newest commit seen. State is one row for each open week."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return counted(results).withWatermark("ts", late).groupBy(week).agg(F.count("*").alias("commits"), *(F.sum(k).alias(k) for k in KINDS)).select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "commits", *KINDS)


def merge_into(path: str):
    """A ``foreachBatch`` function that appends each batch's results to the table at ``path``, a commit once."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["sha"])
        try:
            new = new.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return merge
