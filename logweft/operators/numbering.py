"""Positions without a global window.

A ``row_number()`` over a whole file (or the whole merged log) would put
every row into one task. Instead:

* :func:`rank_within` range-partitions on the ordering key, sorts inside
  each partition, takes each row's position inside its partition from
  ``monotonically_increasing_id`` (its low 33 bits count rows in the
  partition), and adds the number of rows of the same group in earlier
  partitions. That table has at most ``partitions + groups`` rows; it is
  broadcast only when that bound is known to be small, otherwise the join is
  left to the planner (AQE sees its real size at run time).
  The range-partitioned rows are written once (:func:`written_once`, under the
  cluster's ``spark.checkpoint.dir``) before they are counted and numbered:
  two separately planned range shuffles may sample different bounds, and the
  written copy also spares a recomputation when an executor is lost.
* :func:`number_lines` numbers the lines of text files the same way, but
  needs no shuffle at all: a file split is read in order by one task, so a
  line's number is the count of lines in earlier splits of the file plus
  its place in its split.

Both are deterministic on recomputation (a lost executor re-reads the same
split / shuffle block and gets the same numbers).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logweft.session import shared_dir

# Rows of a helper table that one task ranks; more are range-partitioned.
ROWS_IN_TASK = 100_000

# Largest helper table we broadcast on a proven bound: rows and bytes.
BROADCAST_ROW_LIMIT = 5_000_000
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024

_LOW33 = (1 << 33) - 1


def _local_position() -> Column:
    """Row index inside the current partition, in the order rows flow."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))


def maybe_broadcast(df: DataFrame, row_bound: int | None, row_bytes: int = 32) -> DataFrame:
    """Broadcast hint only behind a proven bound (rows, and rows x bytes per
    row); otherwise the planner decides (AQE measures the real size)."""
    if (row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT
            and row_bound * row_bytes <= BROADCAST_BYTE_LIMIT):
        return F.broadcast(df)
    return df


# Bytes of input for one range partition: at most (spill-friendly task size),
# and at least where there are more partitions than cores.
PARTITION_BYTES = 256 * 1024 * 1024
LEAST_BYTES = 1024 * 1024


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle of ``df``: by the sizes of the tables
    that its plan reads (no job, and no guess about joins), and not fewer
    than the session's shuffle partitions. Of a table too small for those
    (``LEAST_BYTES`` each) not fewer than the cores: adaptive execution leaves
    a range shuffle as it is, and every later pass has as many tasks."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [_leaf_bytes(spark, leaves.apply(i)) for i in range(leaves.size())]
    if None not in sizes:
        least = min(least, max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // LEAST_BYTES)))
    return max(least, -(-sum(x or 0 for x in sizes) // PARTITION_BYTES))


def _leaf_bytes(spark: SparkSession, leaf) -> int | None:
    """Bytes that a leaf of a plan reads. A checkpointed table claims what was
    guessed for the plan behind it (a join: the product of its sides), so it
    is measured by its files (metadata only)."""
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        written = leaf.rdd().getCheckpointFile()
        if written.isDefined():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.get())
            return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    claimed = int(str(leaf.stats().sizeInBytes()))
    return claimed if claimed < 1 << 50 else None  # without statistics an immense size: no evidence


# Bytes of a row group of rows that hold long texts: a reader's batch (4,096 rows) ends where its row group does.
LONG_ROWS_BYTES = 16 * 1024 * 1024


def written_once(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: each later pass reads
    only the columns it needs, and in batches, where a checkpoint is read whole
    and row by row. Rows that Parquet cannot hold (a void column, names that
    differ by case alone) are checkpointed. ``group_bytes`` bounds the row
    groups, and by that what a task holds of rows with long texts."""
    path = shared_dir(df.sparkSession, name)  # makes sure a checkpoint folder is set
    try:
        (df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)).parquet(path)
    except AnalysisException:
        return df.checkpoint(eager=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, row_bytes: int) -> DataFrame:
    """A helper table computed once (checkpointed) and counted, with a
    broadcast hint if what was counted is within the bound."""
    shared_dir(df.sparkSession, "small")  # makes sure a checkpoint folder is set
    made = df.checkpoint(eager=True)
    return maybe_broadcast(made, made.count(), row_bytes)


def rank_within(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
                out: str = "pos", partitions: int | None = None,
                max_groups: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order inside its group.

    Ties in ``order_cols`` get distinct, arbitrary-but-consistent positions;
    pass a unique key for a fully determined result. Runs one job at call
    time (the range-partitioned rows are written).
    """
    n = partitions or range_partitions(df)
    groups = list(group_cols)
    keys = [*[F.col(g) for g in groups],
            *[F.col(c) if isinstance(c, str) else c for c in order_cols]]
    alone = n == 1 and not groups       # nothing lies in earlier partitions
    ranged = written_once((df.repartition(1) if alone else df.repartitionByRange(n, *keys))
                            .sortWithinPartitions(*keys)
                            .withColumn("__pid", F.spark_partition_id())
                            .withColumn("__local", _local_position()), "rank")
    if alone:
        return ranged.drop("__pid").withColumnRenamed("__local", out)
    counts = ranged.groupBy(*groups, "__pid").agg(F.count(F.lit(1)).alias("__n"),
                                                  F.min("__local").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__pid") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
                            F.col("__pid").alias("__opid"),
                            (F.coalesce(F.sum("__n").over(before), F.lit(0))
                             - F.col("__first")).alias("__shift"))
    bound = n + max_groups if max_groups is not None else (n if not groups else None)
    # Without a bound on the groups the table is counted (partitions + groups rows).
    offsets = (small_table(offsets, 24 + 256 * len(groups)) if bound is None
               else maybe_broadcast(offsets, bound, 24 + 256 * len(groups)))
    cond = F.col("__pid") == F.col("__opid")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = ranged.join(offsets, cond, "inner")
    return (joined.withColumn(out, F.col("__shift") + F.col("__local"))
                  .drop("__pid", "__opid", "__local", "__shift",
                        *[f"__g{i}" for i in range(len(groups))]))


def number_lines(df: DataFrame, file_col: str = "file", block_col: str = "__block",
                 id_col: str = "__mid", out: str = "line_no",
                 max_blocks: int | None = None, path_bytes: int = 256) -> DataFrame:
    """Line numbers for rows straight out of a text scan.

    ``df`` must carry the split start (``_metadata.file_block_start``) in
    ``block_col`` and ``monotonically_increasing_id()`` taken right above
    the scan in ``id_col``. Lines of one split are consecutive ids, so the
    number is (lines in earlier splits of the file) + (id - first id of the
    split). One aggregate over the split table, one join; no shuffle of the
    lines themselves when the split table is broadcast.
    """
    blocks = df.groupBy(file_col, block_col).agg(F.count(F.lit(1)).alias("__n"),
                                                 F.min(id_col).alias("__first"))
    earlier = Window.partitionBy(file_col).orderBy(block_col) \
                    .rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col(file_col).alias("__bfile"), F.col(block_col).alias("__bstart"),
                            (F.coalesce(F.sum("__n").over(earlier), F.lit(0))
                             - F.col("__first")).alias("__shift"))
    offsets = maybe_broadcast(offsets, max_blocks, path_bytes + 16)
    joined = df.join(offsets, (F.col(file_col) == F.col("__bfile"))
                     & (F.col(block_col) == F.col("__bstart")), "inner")
    return (joined.withColumn(out, F.col("__shift") + F.col(id_col))
                  .drop("__bfile", "__bstart", "__shift"))
