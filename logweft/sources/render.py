"""Log text rendered from the driver's tables (test and bench input only).

These functions only *write text*: they turn rows of ``events``,
``documents`` and ``conversations`` into log lines of a known shape, so the
operators have real input whose true values sit in the original columns.
They do none of an operator's work (no parsing, no numbering, no ordering of
the merge); the log tables are then built by :func:`logs_from_table`.
"""

from __future__ import annotations

import os
import re

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft.sources.tables import logs_from_table

# Fixed values of the rendering rule: status and method per event type.
STATUS_BY_TYPE = {"click": 200, "signup": 201, "purchase": 302, "view": 304, "error": 500}
POST_TYPES = ("signup", "purchase")
ACCESS_FILES = 4
COMBINED_HOSTS = 3
HEADER_LINES = 3


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_time(events: DataFrame) -> Column:
    # The parquet times carry no zone (TIMESTAMP_NTZ); read them as UTC.
    return F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC")


def _status(event_type: Column) -> Column:
    expr = None
    for name, code in STATUS_BY_TYPE.items():
        expr = F.when(event_type == name, F.lit(code)) if expr is None \
            else expr.when(event_type == name, F.lit(code))
    return expr.otherwise(F.lit(0))


def access_lines(events: DataFrame, combined: bool = False) -> DataFrame:
    """One access-log line per event, file ``access.log.{user_id % 4}``."""
    ts = F.date_format(_event_time(events), "dd/MMM/yyyy:HH:mm:ss")
    method = F.when(F.col("event_type").isin(*POST_TYPES), F.lit("POST")).otherwise(F.lit("GET"))
    parts = [
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
        (F.col("event_id") % 256).cast("string"), F.lit(" - - ["), ts, F.lit(" +0000] \""),
        method, F.lit(" /"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"),
        F.lit(" HTTP/1.1\" "), _status(F.col("event_type")).cast("string"), F.lit(" "),
        F.floor(F.abs(F.col("value"))).cast("bigint").cast("string"),
        F.lit(" \"-\" \"agent/"), F.col("user_id").cast("string"), F.lit("\""),
    ]
    if combined:
        parts += [F.lit(" s"), F.col("user_id").cast("string"), F.lit(" "),
                  F.col("event_id").cast("string"), F.lit(" host"),
                  (F.col("user_id") % COMBINED_HOSTS).cast("string"), F.lit(".example.com")]
    prefix = "combined.log." if combined else "access.log."
    return events.select(
        F.concat(F.lit(prefix), (F.col("user_id") % ACCESS_FILES).cast("string")).alias("file"),
        F.col("event_id"), F.concat(*parts).alias("text"))


def access_log(spark: SparkSession, sf_dir: str, combined: bool = False,
               numbered: bool = True) -> DataFrame:
    """The access log as a log table (4 files, lines in event-id order);
    ``numbered=False`` for jobs that only aggregate its lines."""
    lines = access_lines(load(spark, sf_dir, "events"), combined)
    return logs_from_table(lines, "text", "file", order_col="event_id", file_order=numbered,
                           numbered=numbered)


def jsonl_lines(events: DataFrame) -> DataFrame:
    ts = F.date_format(_event_time(events), "yyyy-MM-dd HH:mm:ss.SSS")
    text = F.concat(F.lit('{"ts": "'), ts, F.lit('", "level": "'), F.col("event_type"),
                    F.lit('", "props": '), F.col("props"), F.lit("}"))
    return events.select(
        F.concat(F.lit("events.jsonl."), (F.col("user_id") % ACCESS_FILES).cast("string"))
         .alias("file"),
        F.col("event_id"), text.alias("text"))


def jsonl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = jsonl_lines(load(spark, sf_dir, "events"))
    return logs_from_table(lines, "text", "file", order_col="event_id", file_order=True)


def app_lines(events: DataFrame) -> DataFrame:
    """``{ts,ms} {event_type} user={user_id}`` per event, file ``app.log.{user_id % 4}``,
    and three header lines without a time at the top of every file."""
    file_c = F.concat(F.lit("app.log."), (F.col("user_id") % ACCESS_FILES).cast("string"))
    ts = F.date_format(_event_time(events), "yyyy-MM-dd HH:mm:ss,SSS")
    body = events.select(
        file_c.alias("file"), F.col("event_id").alias("order"),
        F.concat(ts, F.lit(" "), F.col("event_type"), F.lit(" user="),
                 F.col("user_id").cast("string")).alias("text"))
    files = events.select(file_c.alias("file")).distinct()
    header = files.select(
        "file", F.explode(F.sequence(F.lit(1), F.lit(HEADER_LINES))).alias("h"))
    header = header.select(
        "file", (F.col("h") - F.lit(HEADER_LINES + 1)).cast("bigint").alias("order"),
        F.concat(F.lit("# header "), F.col("h").cast("string"), F.lit(" of "), F.col("file"))
         .alias("text"))
    return body.unionByName(header)


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = app_lines(load(spark, sf_dir, "events"))
    return logs_from_table(lines, "text", "file", order_col="order", file_order=True)


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents.text`` split into lines: file = doc_id, line_no = position."""
    docs = load(spark, sf_dir, "documents")
    return logs_from_table(docs, "text", "doc_id")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``: file = conv_id, one line per turn (turn order)."""
    conv = load(spark, sf_dir, "conversations")
    lines = conv.select("conv_id", "turn",
                        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("text"))
    return logs_from_table(lines, "text", "conv_id", order_col="turn")


# Fixed value of the rendering rule: documents go into this many files.
DOC_FILES = 8


def document_files(spark: SparkSession, sf_dir: str, compression: str | None = None) -> str:
    """Write the documents as text log files into a fresh folder of the
    shared checkpoint space; returns the folder.

    File ``bucket=k/part-*`` holds the documents with ``doc_id % 8 == k``,
    one after the other in ``doc_id`` order (one file per bucket). Spark sorts,
    writes and compresses the documents in parts of bounded size, range-
    partitioned by bucket and id, so that no task gets a whole bucket; then the
    parts of a bucket are put behind one another (:func:`_copied`; gzip members
    and bzip2 streams make one file as they are). No text passes through the
    driver. ``compression`` is ``gzip`` or ``bzip2`` for compressed logs.
    """
    from logweft.operators.numbering import range_partitions
    from logweft.session import shared_dir
    path, parts = shared_dir(spark, "document-files"), shared_dir(spark, "document-parts")
    docs = load(spark, sf_dir, "documents").filter(F.col("text") != "")
    docs = (docs.select((F.col("doc_id") % DOC_FILES).alias("bucket"), "doc_id", "text")
                .repartitionByRange(range_partitions(docs), "bucket", "doc_id")
                .sortWithinPartitions("bucket", "doc_id")
                .select("bucket", "text"))
    writer = docs.write.partitionBy("bucket")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(parts)
    _joined_parts(spark, parts, path)
    return path


def _joined_parts(spark: SparkSession, parts: str, path: str) -> None:
    """The part files of each bucket, in the order of their tasks, as one file
    ``bucket=k/part-*`` of another folder; the parts are deleted. Tasks copy;
    the driver gets the names and sizes (at most a task's partitions and one
    more for each bucket)."""
    held: dict[int, list[tuple[int, str]]] = {}
    for uri in spark.read.text(parts).inputFiles():
        bucket, name = re.search(r"bucket=(-?[0-9]+)/([^/]+)$", uri).groups()
        held.setdefault(int(bucket), []).append((int(name.split("-")[1]), uri))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(path))
    joined = []
    for place, (bucket, found) in enumerate(sorted(held.items())):
        uris = [uri for _, uri in sorted(found)]
        end = re.sub(r"^[^.]*", "", uris[0].rsplit("/", 1)[-1])          # .txt, .txt.gz
        files.mkdirs(hadoop(f"{path}/bucket={bucket}"))
        folder = str(files.makeQualified(hadoop(f"{path}/bucket={bucket}")).toString())
        joined.append((f"{folder}/part-{place:05d}-documents{end}", 0, uris))
    _copied(spark, joined)
    files.delete(hadoop(parts), True)


# Bytes that one task copies into a file, where tasks can write at their places of it.
PIECE_BYTES = 64 * 1024 * 1024


def _pieces(at: int, sources: list[str], sizes: dict[str, int], size: int) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """``(place, [(source, start, bytes)])`` of files that follow one another
    from a place of a file on, cut where that file has a multiple of ``size``
    bytes (no two tasks write to one page of it)."""
    out: list[tuple[int, list[tuple[str, int, int]]]] = []
    for uri in sources:
        start = 0
        while start < sizes[uri]:
            n = min(sizes[uri] - start, size - at % size)
            if not out or at % size == 0:
                out.append((at, []))
            out[-1][1].append((uri, start, n))
            start, at = start + n, at + n
    return out


def _copied(spark: SparkSession, files: list[tuple[str, int, list[str]]]) -> None:
    """Copies files behind one another to a place of another file, which ends
    there: ``(target, place, sources)``. Tasks copy at most ``PIECE_BYTES``
    each, straight to their places; on a file system that only writes from
    front to back (anything but a mounted one) a task copies a whole file."""
    from logweft.sources.ranges import file_sizes, located, open_file
    sizes = file_sizes([uri for _, _, sources in files for uri in sources])
    rows = []
    for target, place, sources in files:
        mounted = isinstance(located(target)[0], pafs.LocalFileSystem)
        rows += [(target, mounted, at, held) for at, held in _pieces(place, sources, sizes, PIECE_BYTES if mounted else 1 << 62)]
    if not rows:
        return

    def opened(target, mounted, at):
        source, path = located(target)
        if not mounted:
            return source.open_append_stream(path) if at else source.open_output_stream(path, compression=None)
        new = open(path, "wb", opener=lambda name, flags: os.open(name, flags & ~os.O_TRUNC, 0o666))
        new.seek(at)
        return new

    def of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["target"], r["mounted"], r["at"]) as new:
                    for x in r["sources"]:
                        with open_file(x["uri"]) as old:
                            old.seek(x["start"])
                            left = x["bytes"]
                            while left:
                                data = old.read(min(left, 1 << 20))
                                if not data:
                                    raise OSError(f"{x['uri']} is shorter than it was")
                                new.write(data)
                                left -= len(data)
            yield batch.select(["id"])

    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)],
                               "id int, target string, mounted boolean, at long, sources array<struct<uri: string, start: long, bytes: long>>")
    df.repartitionById(len(rows), "id").mapInArrow(of, "id int").count()


def bucket_of(file_col: str = "file") -> Column:
    """The bucket number in a path written by :func:`document_files`."""
    return F.regexp_extract(F.col(file_col), r"bucket=([0-9]+)/", 1)


def app_log_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the application log as text files ``file=app.log.k/part-*``
    (lines in log order) into a fresh shared folder; returns the folder."""
    from logweft.session import shared_dir
    path = shared_dir(spark, "app-files")
    lines = (app_lines(load(spark, sf_dir, "events"))
             .repartition(ACCESS_FILES, "file").sortWithinPartitions("file", "order")
             .select("file", "text"))
    lines.write.partitionBy("file").text(path)
    return path


def app_file_of(file_col: str = "file") -> Column:
    """The log name in a path written by :func:`app_log_files`."""
    return F.regexp_extract(F.col(file_col), r"file=([^/]+)/", 1)


def entity_lines(events: DataFrame) -> DataFrame:
    """One line per event that holds one entity of each kind, built from the
    event's id, user and type; file ``entity.log.{user_id % 4}``."""
    low = lambda n, width: F.lower(F.lpad(F.hex(n), width, "0"))
    e, u = F.col("event_id"), F.col("user_id")
    parts = [F.lit("10.1."), (u % 256).cast("string"), F.lit("."), (e % 256).cast("string"),
             F.lit(" via fe80::"), low(e % 65536, 4),
             F.lit(" hw 02-00-5e-10-00-00-00-"), low(e % 256, 2), F.lit(" 02-00-5e-10-01-"), low(u % 256, 2),
             F.lit(" id "), low(e, 8), F.lit("-0000-4000-8000-"), low(u, 12),
             F.when(e % 2 == 0, F.lit(" True")).otherwise(F.lit(" False")), F.lit(" None"),
             F.when(e % 3 == 0, F.concat(F.lit(" -"), e.cast("string"))).otherwise(F.lit("")),
             F.lit(" '"), F.col("event_type"), F.lit("' [/v1/"), F.col("event_type"), F.lit("/"),
             u.cast("string"), F.lit("]")]
    return events.select(F.concat(F.lit("entity.log."), (u % ACCESS_FILES).cast("string")).alias("file"),
                         "event_id", F.concat(*parts).alias("text"))


def entity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_table(entity_lines(load(spark, sf_dir, "events")), "text", "file",
                           order_col="event_id", file_order=True)


def long_text(events: DataFrame, width: int = 12_000) -> Column:
    """Access-log line with a referrer of ``width`` characters in front of the
    user agent, longer than any display width; over the columns of ``events``."""
    ts = F.date_format(_event_time(events), "dd/MMM/yyyy:HH:mm:ss")
    return F.concat(F.lit("10.0.0.1 - - ["), ts, F.lit(" +0000] \"GET /"), F.col("event_type"),
                    F.lit(" HTTP/1.1\" "), _status(F.col("event_type")).cast("string"), F.lit(" "),
                    F.col("event_id").cast("string"), F.lit(" \"http://h/"), F.repeat(F.lit("r"), F.lit(width)),
                    F.lit("\" \"agent/"), F.col("user_id").cast("string"), F.lit("\""))


def zone_layout_lines(events: DataFrame) -> DataFrame:
    """Each event's time in one of the seven layouts that
    :func:`mixed_layout_lines` does not write (by ``event_id % 7``)."""
    ts = _event_time(events)
    minus = ts - F.expr("INTERVAL 5 HOURS")
    k = F.col("event_id") % 7
    text = (F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("")))
             .when(k == 1, F.concat(F.date_format(minus, "yyyy-MM-dd HH:mm:ss"), F.lit(" -0500")))
             .when(k == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSS"), F.lit("Z")))
             .when(k == 3, F.concat(F.date_format(minus, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0500")))
             .when(k == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
             .when(k == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(F.lpad(F.unix_micros(ts).cast("string").substr(1, 10), 13, "0")))
    return events.select(F.lit("zones.log").alias("file"), "event_id",
                         F.concat(text, F.lit(" "), F.col("event_type")).alias("text"))


def mixed_layout_lines(events: DataFrame) -> DataFrame:
    """Each event's time in one of eight text layouts (by ``event_id % 8``):
    zoned ``Z`` / ``-0500`` / ``+0530`` shifts, comma and dot fractions, the
    ``T`` separator, syslog without a year, day/month-name/year, epoch
    seconds with microseconds; then ``{event_type} user={user_id}``."""
    ts = _event_time(events)
    us = F.unix_micros(ts)
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    k = F.col("event_id") % 8
    text = (F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("Z")))
             .when(k == 1, F.concat(F.date_format(ts - F.expr("INTERVAL 5 HOURS"),
                                                  "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("-0500")))
             .when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
             .when(k == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSS"))
             .when(k == 4, F.concat(F.date_format(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"),
                                                  "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530")))
             .when(k == 5, F.concat(F.date_format(ts, "MMM"), F.lit(" "), day, F.lit(" "),
                                    F.date_format(ts, "HH:mm:ss")))
             .when(k == 6, F.date_format(ts, "dd/MMM/yyyy HH:mm:ss"))
             .otherwise(F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."),
                                 F.lpad((us % 1_000_000).cast("string"), 6, "0"))))
    return events.select(
        F.concat(F.lit("mixed.log."), (F.col("user_id") % ACCESS_FILES).cast("string")).alias("file"),
        F.col("event_id"),
        F.concat(text, F.lit(" "), F.col("event_type"), F.lit(" user="),
                 F.col("user_id").cast("string")).alias("text"))


def mixed_layout_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mixed_layout_lines(load(spark, sf_dir, "events"))
    return logs_from_table(lines, "text", "file", order_col="event_id", file_order=True)


def joined_lines(lines: DataFrame, between: str, last: str = "") -> DataFrame:
    """The lines of each file, by event id, as one long line in parts
    ``(file, part, text)``, those of neighbouring ids: a line may be longer
    than a row can be. The line is the parts put together as they are."""
    of = F.floor(F.col("event_id") / 4096)
    ends = lines.groupBy(F.col("file").alias("__file")).agg(F.min(of).alias("first"), F.max(of).alias("last"))    # a row for each file
    parts = lines.groupBy("file", of.alias("part")).agg(F.sort_array(F.collect_list(F.struct("event_id", "text"))).alias("held"))
    parts = parts.join(F.broadcast(ends), F.col("file").eqNullSafe(F.col("__file")))
    return parts.select("file", "part", F.concat(
        F.when(F.col("part") > F.col("first"), between).otherwise(""), F.array_join("held.text", between),
        F.when(F.col("part") == F.col("last"), last).otherwise("")).alias("text"))


def cut_copies(spark: SparkSession, folder: str) -> None:
    """Copies of the gzip files of a folder (``bucket=k/...``) beside them
    (``bucket=k/cut.gz``), each with the head of a second member behind it, as
    a writer leaves that was stopped. Tasks copy, one file each."""
    from logweft.sources.ranges import located, open_file
    files = spark.read.text(folder).inputFiles()
    head = bytes([0x1F, 0x8B, 0x08, 0, 0, 0, 0, 0, 0, 3])

    def of(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                source, path = located(uri.rsplit("/", 1)[0] + "/cut.gz")
                with open_file(uri) as old, source.open_output_stream(path, compression=None) as new:
                    while data := old.read(1 << 20):
                        new.write(data)
                    new.write(head)
            yield batch

    spark.createDataFrame([(f,) for f in files], "uri string").repartition(len(files)).mapInArrow(of, "uri string").count()


def append_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Writes the content of each first file behind that of the second, as a
    process does that goes on logging; tasks copy (:func:`_copied`)."""
    from logweft.sources.ranges import file_sizes
    ends = file_sizes([target for _, target in pairs])
    _copied(spark, [(target, ends[target], [source]) for source, target in pairs])


def odd_lines(events: DataFrame) -> DataFrame:
    """Lines with a tab, a colour code, a byte that is no UTF-8, a folded break and carriage returns at the end."""
    parts = [F.encode("event_type", "UTF-8"), F.encode(F.lit("\t"), "UTF-8"), F.encode(F.col("user_id").cast("string"), "UTF-8"),
             F.encode(F.lit("\x1b[31mred\x1b[0m"), "UTF-8"), F.unhex(F.lit("FF")),
             F.encode(F.concat(F.lit("\\n"), F.col("event_id").cast("string"), F.lit("\r\r")), "UTF-8")]
    return events.select(F.lit("odd.log").alias("file"), "event_id", F.concat(*parts).cast("string").alias("text"))
