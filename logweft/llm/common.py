"""Shared pieces of the operators: session settings, tables between jobs, and array hashing.

Text work inside tasks is done with numpy on the Arrow buffers of a text column (no Python string per word). A
*word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; those are all single bytes in UTF-8, so scanning
bytes and scanning code points find the same words.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft.session import configure, shared_dir

#: Words of every text operator (the contract's word class), as a Java / RE2 pattern.
WORD_RX = r"[^\x20\x09-\x0D]+"

#: Bytes of text one numpy step works on (a longer document is a step of its own).
STEP_BYTES = 1 << 20

SETTINGS = {
    # Rows and bytes of one Arrow batch: bounds the memory of a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Jobs are cut by written tables, so a finished job's shuffle files serve nobody.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on."""
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts the lineage, survives lost executors, and is
    computed once however often it is read."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads: what was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it (names do not differ by case)."""
    taken = {x.lower() for x in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucketed_table(rows: DataFrame, buckets: int, key: str, **options: str) -> DataFrame:
    """``rows`` as a table bucketed and sorted by ``key``, its files in the shared checkpoint folder; :func:`dropped`
    removes both. Its name is ``table_name``."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = shared_dir(spark, name)
    rows.write.options(path=path, **options).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    table = spark.table(name)
    table.table_name, table.written_path = name, path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables of :func:`bucketed_table`, files and name."""
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
        removed(table)


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with one row for each non-null id, for operators that join on the id.

    Null texts become empty. Rows without an id cannot be named in a result and are left out. Rows that repeat an id
    are one document; the greatest text stands for it. That merge shuffles texts, so it only runs where a count of
    the ids alone (a narrow, pre-aggregated job) finds repeats.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    again = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")) if again else rows


def copies(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, first_id`` for every document whose exact text is also in a document with a smaller id."""
    digests = rows.select("doc_id", F.sha2(F.col(text_col), 256).alias("digest"))
    groups = (digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("digest", "first_id"))
    return (digests.join(groups, "digest").filter("doc_id > first_id").select("doc_id", "first_id"))


# ------------------------------------------------------------------ texts as arrays
class Texts:
    """Some documents' UTF-8 bytes end to end, with where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k]:self.offsets[k + 1]].tobytes()


def text_steps(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, Texts]]:
    """Cuts a string column into runs of documents of about ``step`` bytes: (first row, texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, side="right")) - 1)
        yield lo, Texts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index range of each document's words (length len(texts) + 1)."""
    inside = ~_SPACE[texts.data]
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


# ------------------------------------------------------------------ hashing
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 62, 256, dtype=np.uint64) * _U(4) + _U(1)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())          # whole powers of two, so that steps of like size share them
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[k] = np.cumprod(steps, dtype=np.uint64)
    return _power[0][:n], _power[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the differences of a polynomial hash over all 64 bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Rolling:
    """Prefix sums of a sequence's 64-bit values, from which any span's hash follows in O(1)."""

    def __init__(self, values: np.ndarray):
        up, _ = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _powers(len(self.sums))
        return mixed((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k consecutive values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        _, down = _powers(len(self.sums))
        return mixed((self.sums[k:] - self.sums[:-k]) * down[:n] + _U(k))


def byte_hashes(texts: Texts) -> Rolling:
    return Rolling(_BYTE[texts.data])


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_hashes(texts).spans(starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if k < width else x


def anchor_positions(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window minima over ``width`` consecutive values: (positions that are the minimum of a window, minimum of each).

    Only windows of valid values count; the minimum of any other is 0. Which positions a window names depends only on
    the values in it, so equal windows name equal relative positions (ties name all of them).
    """
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.cumsum(np.concatenate([[0], valid]))
    least = np.where(whole[width:] - whole[:-width] == width, sliding_min(grams, width), _U(0))
    pad = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), width)
    return np.flatnonzero((most == grams) & valid), least


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges start..start+length-1, end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal disjoint runs (touching runs are one)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    heads = np.flatnonzero(new)
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1]
