"""Sinks: the merged log as text, and the log table as parquet (the index).

A parquet log table sorted by ``file, line_no`` and partitioned by file is
what every navigation operator wants: filters on ``file``, ``line_no`` and
``ts`` prune partitions and row groups at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweft.operators.merge import save_merged
from logweft.operators.numbering import range_partitions

__all__ = ["save_merged", "write_log_table"]


def write_log_table(df: DataFrame, path: str, partition_by_file: bool = False,
                    mode: str = "overwrite") -> None:
    """Write a (parsed) log table as parquet, clustered by file and line.

    Range partitioning on (file, line_no) gives sorted, non-overlapping row
    groups, so ``line_no`` min/max statistics prune pages and row groups.
    """
    n = range_partitions(df)
    out = df.repartitionByRange(n, "file", "line_no").sortWithinPartitions("file", "line_no")
    writer = out.write.mode(mode)
    if partition_by_file:
        writer = writer.partitionBy("file")
    writer.parquet(path)


def read_log_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("line_no", F.col("line_no").cast("bigint"))
