"""Gapless places within groups, however large a group is.

Rows are range-partitioned on group and order, so a hot group spans many partitions; a row's place is its place in its
partition plus the group's rows in earlier partitions (a table of at most partitions + groups rows).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from logweft.llm import common as c
from logweft.operators.numbering import range_partitions

_LOW33 = (1 << 33) - 1


def gapless(rows: DataFrame, group: Sequence[str], order: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """``rows`` (narrow) with ``out``: 0, 1, 2, ... in ``order`` within each ``group``; nulls come first and are a group.

    Equal rows get different places; the input's own order tells them apart, which also spreads a group of repeated rows
    over partitions. The ranged rows are written once, since two range shuffles may sample different bounds.
    """
    keys = [*group, *order, "__row"]
    ranged = (rows.withColumn("__row", F.monotonically_increasing_id())
                  .repartitionByRange(partitions or range_partitions(rows), *keys).sortWithinPartitions(*keys)
                  .withColumn("__part", F.spark_partition_id())
                  .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))).drop("__row"))
    ranged = c.written(ranged, "ranged")
    parts = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*[F.col(x).alias(f"__g{i}") for i, x in enumerate(group)], F.col("__part").alias("__p"),
                          (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for i, x in enumerate(group):
        same = same & F.col(x).eqNullSafe(F.col(f"__g{i}"))
    return ranged.join(shifts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(out))
