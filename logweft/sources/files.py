"""Text log files: plain, gzip, bzip2, one or many, into the log table.

The text reader splits on ``\\n`` only (a lone ``\\r`` stays in the line);
the codec comes from the file name ending (``.gz``, ``.bz2``) as Hadoop
picks it; gzip files are one split each, plain and bzip2 files split.
Provenance comes from the hidden ``_metadata`` column. Line numbers are
computed per split (see :mod:`logweft.operators.numbering`); byte offsets, and
files that break, by :mod:`logweft.sources.ranges`.

Paths are resolved on the driver only as file *metadata* (the listing the
reader does anyway); file contents never pass through the driver.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logweft.functions.lines import decode_lenient, normalize_lines
from logweft.operators.numbering import maybe_broadcast, number_lines
from logweft.sources import ranges
from logweft.sources.tables import natural_key, spread


@dataclass
class LogFiles:
    """Result of :func:`read_logs`: the log table and the paths it could not read."""

    lines: DataFrame
    errors: DataFrame
    files: list[str]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob names anything (one metadata call)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    statuses = hpath.getFileSystem(conf).globStatus(hpath)
    return statuses is not None and len(statuses) > 0


_EMPTY_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*):///"


def _norm_uri(path: str) -> str:
    """One spelling for a path URI: ``file:///x`` and ``file:/x`` agree."""
    return re.sub(_EMPTY_AUTHORITY, r"\1:/", path)


def _natural_sort_key(path: str):
    """:func:`natural_key` for a driver-side path."""
    key = []
    for token in os.path.basename(path).split("."):
        if re.fullmatch("[0-9]+", token):
            digits = token.lstrip("0")
            token = f"{len(digits):010d}{digits}"
        key.append(token.lower())
    return key, path


def sort_paths(paths: Iterable[str]) -> list[str]:
    """Natural name order: ``app.log < app.log.2 < app.log.10`` (same rule
    as :func:`natural_key`, for a driver-side list of paths)."""
    return sorted(paths, key=_natural_sort_key)


def read_logs(spark: SparkSession, paths: str | list[str], on_missing: str = "raise",
              numbered: bool = True, offsets: bool = False) -> LogFiles:
    """Read text logs into the log table.

    ``on_missing``: ``raise`` (default, like the text reader), ``report``
    (read the good paths, list the bad ones in ``errors``) or ``skip``.
    ``numbered`` adds ``line_no``; ``offsets`` adds ``byte_offset`` (position
    in the plain or decompressed text).

    Tolerant reads and reads with offsets go through
    :mod:`logweft.sources.ranges`: a file that breaks in the middle gives all
    lines before the break, and ``errors`` (which reads the files when it is
    asked) names it with the position reached and the unfinished rest.
    Columns: file, file_name, file_size, file_order, line_no, byte_offset,
    raw, line.
    """
    if isinstance(paths, str):
        paths = [paths]
    good: list[str] = []
    bad: list[tuple[str, str]] = []
    for p in paths:
        try:
            found = _exists(spark, p)
        except Exception as err:  # unreadable folder, bad scheme, ...
            bad.append((p, str(err)))
            continue
        if found:
            good.append(p)
        else:
            bad.append((p, "not found"))
    if bad and on_missing == "raise":
        raise FileNotFoundError(f"cannot read: {[b[0] for b in bad]}")
    errors = spark.createDataFrame([(p, e, None, None) for p, e in bad], "path string, error string, position bigint, rest string")

    schema = T.StructType([T.StructField("file", T.StringType()),
                           T.StructField("file_name", T.StringType()),
                           T.StructField("file_size", T.LongType()),
                           T.StructField("file_order", T.IntegerType()),
                           T.StructField("line_no", T.LongType()),
                           T.StructField("byte_offset", T.LongType()),
                           T.StructField("raw", T.StringType()),
                           T.StructField("line", T.StringType())])
    if not good:
        return LogFiles(spark.createDataFrame([], schema), errors, [])

    text = spark.read.option("lineSep", "\n").text(good)
    # The reader's own listing (hidden files skipped), in one call.
    files = sort_paths(_norm_uri(f) for f in text.inputFiles())
    if not files:
        return LogFiles(spark.createDataFrame([], schema), errors, [])
    order = spark.createDataFrame([(f, i) for i, f in enumerate(files)],
                                  "__opath string, file_order int")
    path_bytes = max(len(f.encode()) for f in files)
    if offsets or on_missing != "raise":
        scanned, df, broken = _ranged(spark, files, on_missing != "raise")
        errors = errors.unionByName(broken)
        if not offsets:
            df = df.withColumn("byte_offset", F.lit(None).cast("bigint"))
        if not numbered:
            df = df.withColumn("line_no", F.lit(None).cast("bigint"))
    else:
        df = text.select(F.col("value").alias("raw"),
                         F.regexp_replace(F.col("_metadata.file_path"), _EMPTY_AUTHORITY, "$1:/")
                          .alias("file"),
                         F.col("_metadata.file_name").alias("file_name"),
                         F.col("_metadata.file_size").alias("file_size"),
                         F.col("_metadata.file_block_start").alias("__block"),
                         F.monotonically_increasing_id().alias("__mid"))
        # Splits <= files + partitions: a proven bound for broadcasting the
        # per-split table (one row per split).
        scanned = text._jdf.rdd().getNumPartitions()  # a bare scan: no job
        df = df.withColumn("byte_offset", F.lit(None).cast("bigint"))
        if numbered:
            df = number_lines(df, max_blocks=len(files) + scanned, path_bytes=path_bytes)
        else:
            df = df.withColumn("line_no", F.lit(None).cast("bigint"))
    # The file table is the reader's own listing: its size is known exactly,
    # so it is broadcast when within the bound (one row per file).
    order = maybe_broadcast(order, len(files), path_bytes + 8)
    df = df.join(order, F.col("file") == F.col("__opath"), "left").drop("__opath")
    # Numbers are fixed above (they need the scan's own partitions); the
    # parsing that follows may spread a narrow input over all cores.
    df = spread(df, scanned)
    df = normalize_lines(df)
    return LogFiles(df.select(*schema.fieldNames()), errors, files)


def _ranged(spark: SparkSession, files: list[str], tolerant: bool) -> tuple[int, DataFrame, DataFrame]:
    """Partitions, numbered lines and errors of files read by ranges."""
    plan = ranges.plan_files(spark, files)
    rows = ranges.read_ranges(spark, plan, tolerant)
    lines = ranges.with_positions(rows).withColumn("raw", F.col("raw").cast("string"))
    broken = ranges.read_ranges(spark, plan, only_errors=True).filter("error IS NOT NULL").select(
        F.col("file").alias("path"), "error", F.col("error_at").alias("position"),
        F.nullif(decode_lenient(F.col("raw").cast("string")), F.lit("")).alias("rest"))
    return len(plan), lines, broken


def file_stats(df: DataFrame) -> DataFrame:
    """Per file: lines, text bytes (lines + their newlines) and size on disk."""
    cols = [F.count(F.lit(1)).alias("lines"),
            F.sum(F.octet_length("raw") + F.lit(1)).alias("text_bytes")]
    if "file_size" in df.columns:
        cols.append(F.max("file_size").alias("file_size"))
    return df.groupBy("file").agg(*cols)


def file_order_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, file_order)`` for a driver-side list of paths."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(sort_paths(paths))],
                                 "file string, file_order int")


__all__ = ["read_logs", "file_stats", "sort_paths", "natural_key", "file_order_table", "LogFiles"]
