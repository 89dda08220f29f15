"""Byte ranges of log files as a batch source of its own: offsets without a
shuffle, seeks, gzip files split at members, and files that break in the
middle named instead of skipped.

Each task opens the files it was dealt, reads its ranges in pieces of bounded
size and hands Arrow batches of lines to Spark. A range of a plain file owns
the lines that start behind its first byte up to its end (the first range
also the first line), so a line belongs to one range whatever it is cut by;
an *exact* range begins and ends at line ends. A ``.gz`` file may be dealt as
runs of members (:func:`member_runs`); a ``.bz2`` file is one range.

A file that cannot be opened, or a stream that breaks, gives all lines before
the break and then one row with ``error``, the position in the file up to
which it could be read, and the unfinished rest in ``raw`` - or fails the
task, if the read is not tolerant.

Files are opened through ``pyarrow.fs`` by their URI, so paths must be
reachable from every executor alike.
"""

from __future__ import annotations

import bz2
import json
import re
import zlib
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("file string, file_name string, file_size bigint, block bigint, relative boolean, byte_offset bigint, "
          "raw binary, error string, error_at bigint")
#: Bytes of a plain file, or of a compressed one that can be split, for one task.
CHUNK_BYTES = 128 * 1024 * 1024
# Bytes read at once, fed to a decompressor at once, and of one Arrow batch.
_READ, _FEED, _BATCH = 1 << 20, 1 << 14, 1 << 20
_MARK = b"\xef\xbb\xbf"
_GZIP = b"\x1f\x8b\x08"


class Broken(Exception):
    """A file that cannot be read on, with the position reached in it."""

    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass
class Range:
    """``start`` .. ``end`` of a file (positions in the file as it is stored)."""

    uri: str
    size: int
    start: int
    end: int
    exact: bool = False


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def codec_of(uri: str) -> str | None:
    name = uri.lower()
    return "gzip" if name.endswith(".gz") else "bzip2" if name.endswith(".bz2") else None


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def open_file(uri: str):
    source, path = located(uri)
    return source.open_input_file(path)


def file_sizes(uris: list[str]) -> dict[str, int | None]:
    """Sizes of files (None: not a readable file); metadata only."""
    out = {}
    for uri in uris:
        try:
            source, path = located(uri)
            info = source.get_file_info(path)
            out[uri] = info.size if info.type == pafs.FileType.File else None
        except OSError:
            out[uri] = None
    return out


# ------------------------------------------------------------------ bytes
_EDGE = object()          # the end of the range, between two pieces


def _plain(handle, r: Range) -> Iterator:
    handle.seek(r.start)
    at = r.start
    while at < r.size:
        data = handle.read(min(_READ, (r.end if at < r.end else r.size) - at))
        if not data:
            raise Broken("the file ends before its size", at)
        at += len(data)
        yield data
        if at == r.end:
            yield _EDGE


def _members(handle, r: Range) -> Iterator:
    """Text of the gzip members from the start of a run on; one must begin
    where the run ends."""
    handle.seek(r.start)
    member, at, begun, left, over = zlib.decompressobj(31), r.start, False, b"", False
    while True:
        data, left = left or handle.read(_FEED), b""
        if data and not begun:
            data = data.lstrip(b"\0")                      # padding between members
            if not data:
                continue
            at = handle.tell() - len(data)
            if at >= r.end and not over:
                if at > r.end:
                    raise Broken(f"no gzip member begins at byte {r.end}", at)
                over = True
                yield _EDGE
        if not data:
            if begun:
                raise Broken("the file ends inside a gzip member", at)
            if not over:
                yield _EDGE
            return
        try:
            out = member.decompress(data)
        except zlib.error as err:
            raise Broken(str(err), at) from None
        at, begun = handle.tell(), True
        if out:
            yield out
        if member.eof:
            left, begun, member = member.unused_data, False, zlib.decompressobj(31)


def _blocks(handle, r: Range) -> Iterator:
    stream, at, begun = bz2.BZ2Decompressor(), 0, False
    while True:
        data = handle.read(_FEED)
        if not data:
            if begun:
                raise Broken("the file ends inside a bzip2 stream", at)
            yield _EDGE
            return
        try:
            while data:
                begun = True
                out = stream.decompress(data)
                if out:
                    yield out
                data = b""
                if stream.eof:
                    data, begun, stream = stream.unused_data, False, bz2.BZ2Decompressor()
        except OSError as err:
            raise Broken(str(err), at) from None
        at = handle.tell()


class _Slow:
    """A file that gives single bytes from a place on."""

    def __init__(self, handle, near: int):
        self.handle, self.near, self.seek, self.tell = handle, near, handle.seek, handle.tell

    def read(self, n: int) -> bytes:
        left = self.near - self.handle.tell()
        return self.handle.read(min(n, left) if left > 0 else 1)


def pieces(r: Range) -> Iterator:
    """Text of a range in pieces, and what follows it; ``_EDGE`` at its end.

    What a decompressor had put out before it failed within one feed is lost
    to the caller, so a stream that breaks is read again to that feed, and
    from there byte by byte.
    """
    codec = codec_of(r.uri)
    read = {None: _plain, "gzip": _members, "bzip2": _blocks}[codec]
    done = 0
    try:
        with open_file(r.uri) as handle:
            for piece in read(handle, r):
                done += 0 if piece is _EDGE else len(piece)
                yield piece
            return
    except Broken as broken:
        near = broken.at
        if codec is None:
            raise
    except OSError as err:
        raise Broken(str(err), done) from None
    seen = 0
    with open_file(r.uri) as handle:
        for piece in read(_Slow(handle, near), r):
            if piece is not _EDGE:
                seen += len(piece)
                if seen > done:
                    yield piece[max(0, len(piece) - (seen - done)):]


# ------------------------------------------------------------------ lines
def line_runs(r: Range) -> Iterator[tuple[int, list[bytes]]]:
    """(offset of the first, lines) of the lines that a range owns.

    Offsets of a plain file are positions in it, others count from the first
    line of the range. Raises :class:`Broken` after the lines before a break,
    with the unfinished rest as its last argument.
    """
    plain = codec_of(r.uri) is None
    offset = r.start if plain else 0
    first, skipping, over = r.start == 0, r.start > 0 and not r.exact, False
    held, mark = [], 0                   # an unfinished line; bytes of the byte-order mark before it
    try:
        for piece in pieces(r):
            if piece is _EDGE:
                if r.exact or r.end >= r.size:
                    break
                over = True
                continue
            if first:
                piece = b"".join([*held, piece])
                if len(piece) < 3 and _MARK.startswith(piece):
                    held = [piece]                           # too short to tell
                    continue
                first, held = False, []
                if piece.startswith(_MARK):
                    piece, mark = piece[3:], 3
            if skipping:
                cut = piece.find(b"\n")
                offset += (cut + 1 if cut >= 0 else len(piece)) if plain else 0
                if cut < 0:
                    continue
                if over:                                     # no line starts in the range
                    return
                piece, skipping = piece[cut + 1:], False
            cut = piece.find(b"\n") if over else piece.rfind(b"\n")
            if cut < 0:
                held.append(piece)
                continue
            lines = b"".join([*held, piece[:cut]]).split(b"\n")
            held = [piece[cut + 1:]]
            if mark:
                yield offset, lines[:1]
                offset, mark = offset + len(lines[0]) + 1 + mark, 0
                lines = lines[1:]
            yield offset, lines
            offset += sum(map(len, lines)) + len(lines)
            if over:
                return
    except Broken as broken:
        broken.rest = b"".join(held)
        raise
    rest = b"".join(held)
    if rest and not skipping:
        yield offset, [rest]


def _batch(r: Range, rows: list[tuple[int, bytes]], error: str | None = None, at: int | None = None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r.uri] * n), pa.array([r.uri.rsplit("/", 1)[-1]] * n), pa.array([r.size] * n, pa.int64()),
         pa.array([r.start] * n, pa.int64()), pa.array([codec_of(r.uri) is not None] * n),
         pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()),
         pa.array([error] * n, pa.string()), pa.array([at] * n, pa.int64())],
        [x.split()[0] for x in SCHEMA.split(", ")])


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan = [Ranges([Range(*r) for r in part]) for part in json.loads(options["plan"])]
        self.tolerant = options.get("tolerant", "true") == "true"
        self.lines = options.get("only", "") != "errors"

    def partitions(self):
        return self.plan or [Ranges([])]

    def read(self, partition):
        for r in partition.ranges:
            try:
                rows, held = [], 0
                for offset, lines in line_runs(r):
                    if not self.lines:
                        continue
                    for line in lines:
                        rows.append((offset, line))
                        offset += len(line) + 1
                        held += len(line) + 16
                        if held >= _BATCH:
                            yield _batch(r, rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(r, rows)
            except Broken as broken:
                if not self.tolerant:
                    raise RuntimeError(f"{r.uri}: {broken} (at byte {broken.at})") from None
                if rows:
                    yield _batch(r, rows)
                yield _batch(r, [(None, getattr(broken, "rest", b""))], str(broken), broken.at)


class RangeSource(DataSource):
    """``spark.read.format("logranges")``; see :func:`read_ranges`."""

    @classmethod
    def name(cls) -> str:
        return "logranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, ranges: list[Range], tolerant: bool = True, only_errors: bool = False,
                chunk: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``SCHEMA`` from the ranges; small ones share a task, in order."""
    spark.dataSource.register(RangeSource)
    parts: list[list[list]] = []
    room = 0
    for r in ranges:
        if not parts or room < r.end - r.start:
            parts.append([])
            room = chunk
        parts[-1].append([r.uri, r.size, r.start, r.end, r.exact])
        room -= max(r.end - r.start, 1 << 12)
    df = (spark.read.format("logranges").option("plan", json.dumps(parts)).option("tolerant", str(tolerant).lower())
               .option("only", "errors" if only_errors else "").load())
    df.range_count = len(ranges)
    return df


def plan_files(spark: SparkSession, uris: list[str], chunk: int = CHUNK_BYTES) -> list[Range]:
    """Ranges of whole files: plain ones in chunks, gzip ones longer than a
    chunk in runs of members, others as they are. Files that cannot be looked
    at are a range of no bytes, which says so when it is read."""
    sizes = file_sizes(uris)
    long_gzip = [(u, sizes[u]) for u in uris if codec_of(u) == "gzip" and (sizes[u] or 0) > chunk]
    starts = member_runs(spark, long_gzip, chunk) if long_gzip else {}
    out = []
    for uri in uris:
        size = sizes[uri] or 0
        if codec_of(uri) is None:
            cuts = list(range(0, size, chunk)) or [0]
        else:
            cuts = starts.get(uri, [0])
        out += [Range(uri, size, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
    return out


def _first_member(uri: str, start: int, end: int) -> int | None:
    """The first place in start .. end - 1 at which a whole gzip member
    begins: its header, its data, and the checksum and length behind it."""
    with open_file(uri) as handle:
        handle.seek(start)
        at, window = start, b""
        while at < end:
            data = handle.read(min(_READ, end + 3 - at))
            if not data:
                return None
            window = window[-3:] + data
            base = at + len(data) - len(window)
            hit = window.find(_GZIP)
            while 0 <= hit:
                place = base + hit
                if start <= place < end and (hit + 3 >= len(window) or window[hit + 3] & 0xE0 == 0) and _is_member(uri, place):
                    return place
                hit = window.find(_GZIP, hit + 1)
            at += len(data)
    return None


def _is_member(uri: str, at: int) -> bool:
    member = zlib.decompressobj(31)
    with open_file(uri) as handle:
        handle.seek(at)
        try:
            while not member.eof:
                data = handle.read(_FEED)
                if not data:
                    return False
                member.decompress(data)
        except zlib.error:
            return False
    return True


def member_runs(spark: SparkSession, files: list[tuple[str, int]], chunk: int = CHUNK_BYTES) -> dict[str, list[int]]:
    """Where the runs of members of gzip files begin: one a chunk, if a member
    begins in it. The search runs in tasks, one a chunk; the driver gets one
    number for each. A reader checks every start once more: the run before it
    must end there."""
    asked = [(u, a, min(a + chunk, size)) for u, size in files for a in range(chunk, size, chunk)]
    df = spark.createDataFrame(asked, "uri string, a bigint, b bigint")

    def of(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [_first_member(r["uri"], r["a"], r["b"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(found, pa.int64())], ["uri", "start"])

    found = df.repartition(len(asked)).mapInArrow(of, "uri string, start bigint").filter("start IS NOT NULL")
    starts: dict[str, list[int]] = {u: [0] for u, _ in files}
    for r in found.orderBy("uri", "start").collect():
        starts[r.uri].append(r.start)
    return starts


def with_positions(df: DataFrame) -> DataFrame:
    """Rows of :func:`read_ranges` with ``line_no`` and whole-file
    ``byte_offset``: lines and, for compressed files, bytes of a file's earlier
    ranges come from one row per range; no line is shuffled or windowed."""
    from pyspark.sql import Window
    scanned = df.withColumn("__mid", F.monotonically_increasing_id()).filter("error IS NULL")
    size = F.octet_length("raw") + 1
    ranges = scanned.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("__mid").alias("first"), F.max(F.col("byte_offset") + size).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select(F.col("file").alias("__f"), F.col("block").alias("__b"),
                           (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("__lines"),
                           F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__bytes"))
    out = scanned.join(F.broadcast(shifts) if _few(df) else shifts, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    offset = F.col("byte_offset") + F.when(F.col("relative"), F.col("__bytes")).otherwise(F.lit(0))
    return out.withColumns({"line_no": F.col("__lines") + F.col("__mid"), "byte_offset": offset}).drop("__f", "__b", "__lines", "__bytes", "__mid")


def _few(df: DataFrame) -> bool:
    """Whether the table of ranges is within the broadcast bound (its rows are those of the plan)."""
    from logweft.operators.numbering import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT
    bound = getattr(df, "range_count", None)
    return bound is not None and bound <= BROADCAST_ROW_LIMIT and bound * 512 <= BROADCAST_BYTE_LIMIT
