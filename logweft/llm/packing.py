"""Variable-capacity best-fit packing.

Documents become *pieces* (a document longer than the largest permitted sequence is cut into whole sequences and a
rest) and pieces are packed into sequences of several permitted lengths. Only (id, piece, length) rows move: a hash of
the row deals them to shards of about ``shard_words`` words, each large enough to pack tightly and small enough for one
task, however many documents there are and whatever ids repeat.

In a shard, pieces go in order of falling length into the open bin that they fill best. Where none fits, a bin is
opened whose size costs least per word, given what the pieces still to come could put into it; the cost of a size is
its length plus a quadratic term for attention. In the end each bin shrinks to the smallest permitted length that
holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweft.llm import common as c

CAPACITIES = (512, 1024, 2048, 4096)
#: Length at which attention costs as much as everything else.
ATTENTION_WORDS = 8192
SHARD_WORDS = 4_000_000


def sequence_cost(capacity: int, attention_words: int = ATTENTION_WORDS) -> float:
    return capacity + capacity * capacity / attention_words


def _least_cost_size(length: int, waiting: list[int], left: Counter, capacities: Sequence[int],
                     attention_words: int) -> int:
    """The permitted size with the least cost per word if waiting pieces, longest first, fill what ``length`` leaves."""
    best = None
    for size in capacities:
        if size < length:
            continue
        room, i = size - length, len(waiting)
        while room > 0:
            i = bisect_right(waiting, room, 0, i) - 1
            if i < 0:
                break
            room -= waiting[i] * min(left[waiting[i]], room // waiting[i])
        rate = sequence_cost(size, attention_words) / (size - room)
        if best is None or rate < best[0]:
            best = (rate, size)
    return best[1]


def pack_lengths(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES,
                 attention_words: int = ATTENTION_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin and final size of the bin for each length (1 .. max capacity)."""
    capacities = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = Counter(lengths.tolist())
    waiting = sorted(left)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    used: list[int] = []
    spaces: list[int] = []                       # distinct free spaces of open bins, ascending
    open_bins: dict[int, list[int]] = defaultdict(list)
    size_of: list[int] = []
    for i in order.tolist():
        length = int(lengths[i])
        left[length] -= 1
        if not left[length]:
            waiting.pop()                        # lengths fall, so it is the last
        at = bisect_left(spaces, length)
        if at < len(spaces):
            space = spaces[at]
            b = open_bins[space].pop()
            if not open_bins[space]:
                spaces.pop(at)
        else:
            space = _least_cost_size(length, waiting, left, capacities, attention_words)
            b = len(used)
            used.append(0)
            size_of.append(space)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        if space > length:
            if not open_bins[space - length]:
                insort(spaces, space - length)
            open_bins[space - length].append(b)
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if used else np.zeros(len(lengths), np.int64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words`` per row (nulls have no words)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(c.word_spans(texts)[2]) for _, texts in c.text_steps(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else [], pa.int64())],
                ["doc_id", "n_words"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
               .mapInArrow(of, "doc_id long, n_words long")


_PACKED = "doc_id long, piece long, start long, n_words long, bin_id long, bin_offset long, capacity long"


def pack(items: DataFrame, capacities: Sequence[int] = CAPACITIES, attention_words: int = ATTENTION_WORDS,
         shard_words: int = SHARD_WORDS) -> DataFrame:
    """Packs ``doc_id, n_words`` rows: one row per piece with its bin, its offset there and the bin's final size.

    ``start`` is the piece's first word in its document. A document without words (null length, 0) is one row with
    null bin. Repeated rows are packed one by one; null ids are packed like others. The bins of a shard are numbered
    in order of opening; ``bin_id`` is shard * 2^32 + number. An empty table gives an empty result.
    """
    spark = c.prepare(items.sparkSession)
    top = max(capacities)
    items = items.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_words"), F.lit(0)).cast("long").alias("n"))
    rows = items.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top), F.lit(1)) - 1))
        .alias("piece")).select("doc_id", "row", "piece", (F.col("piece") * top).alias("start"),
                                F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("n_words"))
    rows = c.written(rows, "pieces")
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "row", "piece"], na_position="first").reset_index(drop=True)
        bins, offsets, sizes = pack_lengths(frame["n_words"].to_numpy(), capacities, attention_words)
        out = frame[["doc_id", "piece", "start", "n_words"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin_id"] = (int(frame["shard"].iloc[0]) << 32) + bins
        out["bin_offset"], out["capacity"] = offsets, sizes
        return out

    dealt = rows.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(of, _PACKED)
    none = F.lit(None).cast("long")
    return packed.unionByName(rows.filter("n_words = 0").select(
        "doc_id", "piece", "start", "n_words", none.alias("bin_id"), none.alias("bin_offset"), none.alias("capacity")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`pack` over the word counts of ``docs``.

    Null and empty texts have no words: one row each, without a bin. Repeated rows are packed one by one, null ids are
    packed like others, other columns are ignored, and an empty table gives an empty result.
    """
    c.prepare(docs.sparkSession)
    return pack(word_counts(docs, id_col, text_col), **options)
