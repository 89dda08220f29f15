"""A sparse line index: pages, go-to and time jumps on raw log files by seek.

The index has one row per block of lines of a file: its first line, number of
lines, byte range and, for timed logs, the first and last time in it. It is
built by one aggregate over a log with byte offsets (a block's lines are
combined where they are read) and is meant to be kept (``write_index``). What
a user asks for is then answered from the few blocks that hold it: their
ranges are read by position, nothing else of the files is opened.

Only plain text files can be read by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft.functions.lines import normalize_lines
from logweft.functions.timestamps import extract_timestamp
from logweft.operators import navigate
from logweft.sources import ranges
from logweft.sources.files import read_logs

#: Lines of one block.
EVERY = 1000
INDEX_SCHEMA = ("file string, file_size bigint, first_line bigint, lines bigint, byte_start bigint, byte_end bigint, "
                "min_ts timestamp, max_ts timestamp")


def line_index(spark: SparkSession, paths: str | list[str], every: int = EVERY, timed: bool = False) -> DataFrame:
    """``INDEX_SCHEMA`` rows for plain log files; ``timed`` fills the times."""
    found = read_logs(spark, paths, offsets=True)
    packed = [f for f in found.files if ranges.codec_of(f)]
    if packed:
        raise ValueError(f"compressed logs cannot be read by position: {packed}")
    lines = extract_timestamp(found.lines) if timed else found.lines.withColumn("ts", F.lit(None).cast("timestamp"))
    blocks = lines.groupBy("file", "file_size", F.floor(F.col("line_no") / every).alias("block")).agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.min("byte_offset").alias("byte_start"),
        F.max(F.col("byte_offset") + F.octet_length("raw") + 1).alias("end"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    # the next block's start is a block's end (a byte-order mark is in no line)
    return blocks.select("file", "file_size", "first_line", "lines", "byte_start",
                         F.least("end", "file_size").alias("byte_end"), "min_ts", "max_ts")


def write_index(index: DataFrame, path: str) -> None:
    """Keeps an index as Parquet, sorted so that a file's blocks are pruned by name and line."""
    index.repartitionByRange("file", "first_line").sortWithinPartitions("file", "first_line").write.parquet(path)


def read_blocks(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """The lines of some blocks (``INDEX_SCHEMA`` rows: as many as a page, or a
    line of each file, asks for; the plan is made on the driver) as a log
    table ``file, line_no, byte_offset, raw, line``."""
    wanted = blocks.select("file", "file_size", "byte_start", "byte_end", "first_line").distinct() \
                   .orderBy("file", "byte_start").collect()
    plan = [ranges.Range(r.file, r.file_size, r.byte_start, r.byte_end, True) for r in wanted]
    rows = ranges.read_ranges(spark, plan, tolerant=False)
    firsts = spark.createDataFrame([(r.file, r.byte_start, r.first_line) for r in wanted], "f string, b bigint, first_line bigint")
    rows = rows.withColumn("__mid", F.monotonically_increasing_id())
    start = rows.groupBy("file", "block").agg(F.min("__mid").alias("__first")).join(
        firsts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
        "f", "b", (F.col("first_line") - F.col("__first")).alias("__shift"))
    lines = rows.join(start, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
        "file", (F.col("__mid") + F.col("__shift")).alias("line_no"), "byte_offset", F.col("raw").cast("string").alias("raw"))
    return normalize_lines(lines)


def _last_lines(index: DataFrame) -> DataFrame:
    return index.groupBy("file").agg(F.max(F.col("first_line") + F.col("lines") - 1).alias("last_line"))


def page_by_index(spark: SparkSession, index: DataFrame, start: int, count: int) -> DataFrame:
    """Lines ``start`` .. ``start + count - 1`` of every file of the index."""
    asked = index.filter((F.col("first_line") < start + count) & (F.col("first_line") + F.col("lines") > start))
    return navigate.line_page(read_blocks(spark, asked), start, count)


def goto_by_index(spark: SparkSession, index: DataFrame, n: int | str) -> DataFrame:
    """:func:`navigate.goto_line` of every file of the index."""
    try:
        target = max(int(n) - 1, 0)
    except (TypeError, ValueError):
        return read_blocks(spark, index.limit(0))
    asked = index.filter(F.col("first_line") <= target).groupBy("file").agg(
        F.max_by(F.struct(*index.columns), "first_line").alias("b")).select("b.*")
    return navigate.goto_line(read_blocks(spark, asked), n)


def time_jump_by_index(spark: SparkSession, index: DataFrame, line_no: int, steps: int, unit: str) -> DataFrame:
    """:func:`navigate.time_jump` of every file of a timed index.

    Read are the blocks with the base line, and one more a file: the first
    later block that reaches the target time, or the last earlier one that
    goes back to it.
    """
    near = index.filter((F.col("first_line") <= line_no + 10) & (F.col("first_line") + F.col("lines") > line_no))
    last = _last_lines(index)
    base = navigate.time_jump(extract_timestamp(read_blocks(spark, near)), line_no, steps, unit)
    base = base.select("file", "base_line", "target_ts")
    blocks = index.join(base, "file").withColumn("last_line", F.col("first_line") + F.col("lines") - 1)
    own = (F.col("first_line") <= F.col("base_line")) & (F.col("base_line") <= F.col("last_line"))
    if steps > 0:
        there = (F.col("first_line") > F.col("base_line")) & (F.col("max_ts") >= F.col("target_ts"))
        other = blocks.filter(there).groupBy("file").agg(F.min_by(F.struct(*blocks.columns), "first_line").alias("b"))
    else:
        there = (F.col("last_line") < F.col("base_line")) & (F.col("min_ts") <= F.col("target_ts"))
        other = blocks.filter(there).groupBy("file").agg(F.max_by(F.struct(*blocks.columns), "first_line").alias("b"))
    asked = blocks.filter(own).unionByName(other.select("b.*"))
    lines = extract_timestamp(read_blocks(spark, asked.select(*index.columns))).join(base, "file")
    at, ts = F.col("line_no"), F.col("ts")
    if steps > 0:
        hit = F.min(F.when((at > F.col("base_line")) & (ts >= F.col("target_ts")), at))
    else:
        hit = F.max(F.when((at < F.col("base_line")) & (at > 0) & (ts <= F.col("target_ts")), at))
    hits = lines.groupBy("file").agg(hit.alias("hit"))
    fallback = F.col("last_line") if steps > 0 else F.lit(0).cast("bigint")
    return (base.join(last, "file").join(hits, "file", "left")
                .select("file", "base_line", "target_ts", F.coalesce("hit", fallback).alias("line_no")))
