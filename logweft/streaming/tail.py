"""Tail growing log files as a Structured Streaming source.

The file source of Spark only sees *new files*; a log grows in place. This
is a Python streaming data source whose offset per file is the byte
position just after the last complete line (a half-written last line waits
for its newline). Each micro-batch reads the appended byte range of every
file in executor tasks - the driver only looks at file sizes and at the
tail of a file to find its last newline, never at the data.

Options (``spark.readStream.format("logtail").option(...)``):

* ``paths``: comma-separated files to follow (plain text; compressed files
  cannot grow and are refused).
* ``startingPosition``: ``latest`` (default: only lines written from now)
  or ``earliest`` (the history first, then new lines).
* ``maxBytesPerTrigger``: cap of bytes per file per batch, cut at a line
  end (a line longer than the cap is a batch of its own). It holds for every
  batch, the first after a restart too; an ``availableNow`` run is one batch
  (a Python source is not asked for more; see ``streams.drain``).
* ``endOffsets``: JSON ``{path: position}``; no batch reads past it.
* ``chunkBytes``: a large range is read by several tasks, each owning the
  lines that *start* in its chunk (default 32 MiB).

Offsets are ``{path: {"gen": g, "pos": p, "head": h, "last": l}}``. ``head``
and ``last`` are digests of the first bytes and of those just before ``pos``
(up to 1 KiB each of what was read). When a file shrinks below its offset, or
these bytes are no longer the same (truncated, or rotated and already longer
than before, be it with the same header), ``gen`` goes up and reading restarts
at 0. Paths must be mounted alike on the driver and all executors.
A file that cannot be read keeps its old offset and is skipped; the others
go on. The failure is reported once, as a row whose ``error`` column holds
the message (``error`` is NULL on every line).
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, byte_offset bigint, raw string, error string"
# Fixed value: read size when looking back for the last newline (64 KiB).
LOOKBACK = 64 * 1024
DEFAULT_CHUNK = 32 * 1024 * 1024


def last_line_end(path: str, size: int, floor: int = 0) -> int:
    """Position just after the last ``\\n`` in ``path`` below ``size`` (and
    not below ``floor``); ``floor`` when there is none."""
    if size <= floor:
        return floor
    with open(path, "rb") as fh:
        end = size
        while end > floor:
            start = max(floor, end - LOOKBACK)
            fh.seek(start)
            block = fh.read(end - start)
            hit = block.rfind(b"\n")
            if hit >= 0:
                return start + hit + 1
            end = start
    return floor


def first_line_end(path: str, start: int, size: int) -> int:
    """Position just after the first ``\n`` at or after ``start`` and below
    ``size``; ``start`` when there is none."""
    with open(path, "rb") as fh:
        fh.seek(start)
        at = start
        while at < size:
            block = fh.read(min(LOOKBACK, size - at))
            hit = block.find(b"\n")
            if hit >= 0:
                return at + hit + 1
            if not block:
                break
            at += len(block)
    return start


# Fixed value: bytes at either end of what was read that tell a file from its
# successor.
MARK_BYTES = 1024


def _digest(path: str, start: int, end: int) -> str:
    """``start:end:digest`` of a range of bytes."""
    with open(path, "rb") as fh:
        fh.seek(start)
        data = fh.read(end - start)
    return f"{start}:{start + len(data)}:{hashlib.sha256(data).hexdigest()[:32]}"


def file_marks(path: str, pos: int) -> dict[str, str]:
    """Digests of the first bytes and of the last ones before ``pos``."""
    if not pos:
        return {}
    return {"head": _digest(path, 0, min(MARK_BYTES, pos)), "last": _digest(path, max(0, pos - MARK_BYTES), pos)}


def same_file(path: str, marks: dict) -> bool:
    """Whether a file still holds the bytes that the marks of an offset stand for."""
    for mark in (marks.get("head"), marks.get("last")):
        if mark:
            start, end = (int(x) for x in mark.split(":")[:2])
            if _digest(path, start, end) != mark:
                return False
    return True


@dataclass
class TailError(InputPartition):
    path: str
    message: str


@dataclass
class TailPartition(InputPartition):
    path: str
    start: int      # first byte of the file range of this batch
    chunk_start: int
    chunk_end: int  # this task owns lines starting in [chunk_start, chunk_end)
    end: int        # end of the batch range (just after a newline)


def _check_paths(paths: list[str]) -> list[str]:
    for p in paths:
        if p.endswith((".gz", ".bz2")):
            raise ValueError(f"compressed logs cannot be tailed: {p}")
    return paths


# Fixed value: text bytes of one Arrow batch (1 MiB).
BATCH_BYTES = 1024 * 1024


def _batch(path: str, starts: list, lines: list, error: str | None = None) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string()),
         pa.array([error] * n, pa.string())], ["file", "byte_offset", "raw", "error"])


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        paths = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]
        if not paths:
            raise ValueError("option 'paths' is required")
        self.paths = _check_paths(paths)
        self.starting = options.get("startingPosition", "latest").lower()
        cap = options.get("maxBytesPerTrigger")
        self.cap = int(cap) if cap else None
        self.chunk = int(options.get("chunkBytes", DEFAULT_CHUNK))
        self.ends = json.loads(options.get("endOffsets", "{}"))
        self._initial: dict | None = None
        # last offset handed out; a restarted query learns it (commit, or the
        # batch it runs again) before it asks for more
        self._known: dict | None = None

    def _size(self, path: str) -> int | None:
        try:
            return os.path.getsize(path)
        except OSError:
            return None

    def initialOffset(self) -> dict:
        if self._initial is not None:      # asked again after the first batch was planned
            return self._initial
        out = {}
        for p in self.paths:
            size = self._size(p)
            pos = 0
            if self.starting == "latest" and size is not None:
                pos = last_line_end(p, size)
            out[p] = {"gen": 0, "pos": pos, **file_marks(p, pos)}
        self._initial = out
        return out

    def latestOffset(self) -> dict:
        base = self.initialOffset() if self._known is None else self._known
        out = {}
        for p in self.paths:
            prev = base.get(p, {"gen": 0, "pos": 0})
            kept = {k: prev[k] for k in ("gen", "pos", "head", "last") if k in prev}
            size = self._size(p)
            if size is None:          # unreadable now: keep its place, skip it
                out[p] = {**kept, "err": "cannot read file"}
                continue
            gen, floor = prev["gen"], prev["pos"]
            try:
                if size < floor or not same_file(p, prev):
                    gen, floor = gen + 1, 0   # truncated or rotated: start again at 0
                size = max(floor, min(size, self.ends.get(p, size)))
                limit = size if self.cap is None else min(size, floor + self.cap)
                pos = last_line_end(p, limit, floor)
                if pos == floor and limit < size:
                    # one line longer than the cap: that line, and no more
                    pos = first_line_end(p, limit, size)
                    pos = floor if pos == limit else pos
                out[p] = {"gen": gen, "pos": pos, **file_marks(p, pos)}
            except OSError as err:
                out[p] = {**kept, "err": str(err)}
        self._known = out
        return out

    def partitions(self, start: dict, end: dict):
        parts = []
        for p in self.paths:
            e = end.get(p)
            if e is None:
                continue
            s = start.get(p, {"gen": e["gen"], "pos": 0})
            if e.get("err"):
                if not s.get("err"):   # report a failure once, when it starts
                    parts.append(TailError(p, e["err"]))
                continue
            lo = s["pos"] if s["gen"] == e["gen"] else 0
            hi = e["pos"]
            a = lo
            while a < hi:
                b = min(hi, a + self.chunk)
                parts.append(TailPartition(p, lo, a, b, hi))
                a = b
        self._known = end
        return parts

    def read(self, partition):
        """Arrow batches of the lines a task owns."""
        part = partition
        if isinstance(part, TailError):
            yield _batch(part.path, [None], [None], part.message)
            return
        try:
            fh = open(part.path, "rb")
        except OSError as err:
            yield _batch(part.path, [None], [None], f"cannot read file: {err}")
            return
        starts, lines, held = [], [], 0
        with fh:
            pos = part.chunk_start
            if pos > part.start:
                # The line that straddles the chunk start belongs to the
                # previous chunk: skip to just after the next newline.
                fh.seek(pos - 1)
                skipped = fh.readline()
                pos = pos - 1 + len(skipped)
            else:
                fh.seek(pos)
            while pos < part.chunk_end and pos < part.end:
                data = fh.readline()
                if not data:
                    break
                line_start = pos
                pos += len(data)
                if pos > part.end:
                    break  # never past the batch end (a line still being written)
                text = data[:-1] if data.endswith(b"\n") else data
                starts.append(line_start)
                lines.append(text.decode("utf-8", errors="replace"))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _batch(part.path, starts, lines)
                    starts, lines, held = [], [], 0
        if lines:
            yield _batch(part.path, starts, lines)

    def commit(self, end: dict) -> None:
        self._known = end


class TailSource(DataSource):
    """``spark.readStream.format("logtail")``."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TailSource)
