"""Streams of log lines and the stream forms of the operators.

Every line projection of the library (timestamps, formats, entities,
search) is stateless, so it applies to a streaming DataFrame unchanged;
the helpers here only add what a stream needs: a source, watermarks for
windowed counts, and the running count of unseen lines.
"""

from __future__ import annotations

import json
import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweft.functions.formats import classify_lines, parse_access_log
from logweft.functions.lines import normalize_lines
from logweft.functions.timestamps import extract_timestamp
from logweft.operators.search import Search, _search
from logweft.streaming.tail import _check_paths, last_line_end, register


def tail_logs(spark: SparkSession, paths: str | list[str], starting_position: str = "latest",
              max_bytes_per_trigger: int | None = None, chunk_bytes: int | None = None,
              end_offsets: dict[str, int] | None = None) -> DataFrame:
    """Stream of the complete lines appended to growing files.

    Columns: file, byte_offset (where the line starts), raw, line, error
    (NULL on lines; a row with the message when a file cannot be read, which
    is then skipped while the others go on). Pause / resume = stop the query
    and start it again on the same checkpoint: it continues at the stored
    offsets.
    """
    if isinstance(paths, str):
        paths = [paths]
    _check_paths(paths)  # compressed files cannot grow: refuse before starting
    register(spark)
    reader = (spark.readStream.format("logtail")
                   .option("paths", ",".join(paths))
                   .option("startingPosition", starting_position))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    if chunk_bytes:
        reader = reader.option("chunkBytes", str(chunk_bytes))
    if end_offsets is not None:
        reader = reader.option("endOffsets", json.dumps(end_offsets))
    return normalize_lines(reader.load())


def drain(spark: SparkSession, paths: str | list[str], checkpoint: str, write: Callable[[DataFrame], DataStreamWriter],
          max_bytes_per_trigger: int, starting_position: str = "latest") -> int:
    """Reads all that the files hold now, in batches of at most
    ``max_bytes_per_trigger`` bytes a file; gives the number of batches.

    The ends are fixed at the start, so files that go on growing end no later.
    Structured Streaming asks a source for the limit of each batch of an
    ``availableNow`` run only through interfaces that Python sources do not
    have (``DataSourceStreamReader`` of PySpark 4.1 has no read limit); such a
    run is one batch of them. So this plans a series of runs on one checkpoint:
    each takes the next capped batch, and a restart goes on where it stopped.
    ``write`` turns the stream into a writer without trigger and checkpoint.
    """
    paths = [paths] if isinstance(paths, str) else paths
    ends = {p: last_line_end(p, os.path.getsize(p)) for p in paths if os.path.exists(p)}
    batches = 0
    while True:
        stream = tail_logs(spark, paths, starting_position, max_bytes_per_trigger, end_offsets=ends)
        query = write(stream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        source = json.loads(query.lastProgress.json)["sources"][0] if query.lastProgress else {}
        reached, begun = source.get("endOffset") or {}, source.get("startOffset") or {}
        moved = any(reached[p]["pos"] != begun.get(p, {"pos": 0})["pos"] for p in reached)
        batches += 1 if moved else 0
        if not moved or all(reached.get(p, {"pos": 0})["pos"] >= end for p, end in ends.items()):
            return batches


def stream_log_dir(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the lines of log files landing in a folder (rotated files,
    shipped logs). Columns: file, file_name, raw, line."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(path)
    df = df.select(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_name").alias("file_name"),
                   F.col("value").alias("raw"))
    return normalize_lines(df)


def parse_stream(df: DataFrame) -> DataFrame:
    """Times, formats and access-log columns of streamed lines."""
    return parse_access_log(classify_lines(extract_timestamp(df)))


def search_stream(df: DataFrame, find: str | Search, regex: bool = False,
                  case_sensitive: bool = False, col: str = "line") -> DataFrame:
    """Streamed lines holding ``find``."""
    return df.filter(_search(find, regex, case_sensitive).matches(col))


def pending_lines(df: DataFrame, seen: dict[str, int] | None = None) -> DataFrame:
    """Running count of lines per file past the position the reader has
    seen (``seen``: file -> byte offset; all lines when None). Use with
    ``outputMode("update")`` or ``("complete")``."""
    if "error" in df.columns:
        df = df.filter(F.col("error").isNull())  # error reports are no lines
    if seen:
        # a map literal: one lookup per line, however many files
        known = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
        df = df.filter(F.col("byte_offset") >= F.coalesce(F.try_element_at(known, F.col("file")), F.lit(0)))
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("pending_lines"))


def lines_over_time_stream(df: DataFrame, unit: str = "1 minute", delay: str = "10 minutes",
                           timed: bool = False) -> DataFrame:
    """Live lines per time window and file; a window is emitted once the
    watermark (latest time - ``delay``) passes its end (append mode)."""
    if not timed:
        df = extract_timestamp(df)
    return (df.filter(F.col("ts").isNotNull())
              .withWatermark("ts", delay)
              .groupBy(F.window("ts", unit).alias("window"), "file")
              .agg(F.count(F.lit(1)).alias("lines"))
              .select(F.col("window.start").alias("period"), "file", "lines"))
