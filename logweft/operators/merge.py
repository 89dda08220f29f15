"""Merge several logs into one time-ordered log.

Order key per line: (time in epoch microseconds, line number, file order).
A line without a time sorts as epoch 0 (so before 1970+ lines, after
pre-1970 ones such as year-less syslog lines), unless it is in the header
of its file: when the first timed line of a file is among its first twelve
lines, every line above it takes its time.

The order is a range shuffle + sort (external, spills); positions in the
merged log come from zone maps and, where files overlap in time, from ranks of
the keys, never from one global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweft.functions.timestamps import extract_timestamp
from logweft.operators.numbering import range_partitions, rank_within, small_table
from logweft.operators.runs import key_table, merged_by_zones

# Fixed value: the header back-fill looks at lines 0..11 of a file.
HEADER_SCAN_LINES = 12

MERGE_KEY = ["ts_key", "line_no", "file_order"]


def ts_key_col(ts: str = "ts") -> F.Column:
    """Epoch microseconds; an untimed line is 0."""
    return F.coalesce(F.unix_micros(F.col(ts)), F.lit(0).cast("bigint"))


def backfill_header(df: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Add ``ts_key``: the merge time of each line, with the header filled.

    The fill table has one row per file (the first timed line within the
    first twelve lines); lines above that line take its time.
    """
    keyed = df.withColumn("ts_key", ts_key_col())
    # Only the line filter goes down to the scan; untimed lines are skipped
    # by the NULL ordering of min_by (no predicate on the parsed time, whose
    # expression would otherwise be copied into the filter).
    timed_line = F.when(F.col("ts_key") != 0, F.col("line_no"))
    fill = (keyed.filter(F.col("line_no") < HEADER_SCAN_LINES)
                 .groupBy(*by)
                 .agg(F.min_by(F.struct(F.col("line_no").alias("fill_line"),
                                        F.col("ts_key").alias("fill_key")), timed_line)
                      .alias("__fill"))
                 .filter(F.col("__fill").isNotNull())
                 .select(*[F.col(b).alias(f"__f_{b}") for b in by],
                         F.col("__fill.fill_line").alias("__fill_line"),
                         F.col("__fill.fill_key").alias("__fill_key")))
    fill = small_table(fill, 24 + 256 * len(by))  # one row per file with a header; counted
    cond = None
    for b in by:
        c = F.col(b).eqNullSafe(F.col(f"__f_{b}"))
        cond = c if cond is None else cond & c
    joined = keyed.join(fill, cond, "left")
    return (joined.withColumn("ts_key",
                              F.when(F.col("line_no") < F.col("__fill_line"), F.col("__fill_key"))
                               .otherwise(F.col("ts_key")))
                  .drop("__fill_line", "__fill_key", *[f"__f_{b}" for b in by]))


def merge_logs(df: DataFrame, timed: bool = False, by_time: bool = True) -> DataFrame:
    """The lines of all files in merged order (a globally sorted DataFrame).

    ``df`` is a log table with ``file_order``; ``timed`` says it already has
    ``ts``. ``by_time=False`` keeps file order instead, as a viewer shows a
    single file as it is (see :func:`several_files`).
    """
    if not timed:
        df = extract_timestamp(df)
    keyed = backfill_header(df)
    return keyed.orderBy(*(MERGE_KEY if by_time else ["file_order", "line_no"]))


def several_files(df: DataFrame) -> bool:
    """Whether a log table holds more than one file (a narrow job): the
    ``by_time`` of a viewer that merges two files or more."""
    return df.select("file_order").distinct().limit(2).count() > 1


def merged_positions(df: DataFrame, timed: bool = False, partitions: int | None = None) -> DataFrame:
    """Add ``merged_no``: the 0-based position of each line in the merged log.

    Zone maps of the files' blocks (:mod:`logweft.operators.runs`) give the
    places of all lines whose block overlaps no other one; only the keys of
    the others are range-partitioned and numbered. ``partitions`` asks for one
    range shuffle of all lines instead (a log whose lines are in no order);
    so is a log ranked in which a line has no number or its file no order.
    """
    if not timed:
        df = extract_timestamp(df)
    keyed = backfill_header(df)
    # lines without a number, or of files without a place, are no runs
    loose = F.col("file_order").isNull() | F.col("line_no").isNull()
    if partitions is not None:
        return rank_within(keyed, MERGE_KEY, out="merged_no", partitions=partitions)
    keys = key_table(keyed)
    if keys.filter(loose).limit(1).count():
        return rank_within(keyed, MERGE_KEY, out="merged_no")
    return merged_by_zones(keyed, keys=keys)


def save_merged(df: DataFrame, path: str, timed: bool = False, count: bool = True,
                partitions: int | None = None) -> int | None:
    """Write the merged log as text, in merged order, blank lines dropped.

    Part files are range partitions of the merge key, so their name order is
    the merged order (concatenate them to get one log). Returns the number of
    lines written (read back from the output) when ``count``.
    """
    if not timed:
        df = extract_timestamp(df)
    keyed = backfill_header(df).filter(F.col("line") != "")
    spark = df.sparkSession
    n = partitions or range_partitions(df)
    out = (keyed.repartitionByRange(n, *MERGE_KEY)
                .sortWithinPartitions(*MERGE_KEY)
                .select("line"))
    out.write.mode("overwrite").text(path)
    if count:
        return spark.read.option("lineSep", "\n").text(path).count()
    return None
