"""Suffix-array deduplication over bytes.

A byte is removed if it lies in a ``length``-byte string that also starts in a document with a smaller id. Equal
strings have equal suffixes at equal places, so a sorted list of suffixes shows them as neighbours. Sorting a suffix
for every byte would move the corpus fifty times over; the list is therefore sparse, and loses nothing:

1. ``anchors``: a ``length``-byte string is represented by the smallest hash of its ``gram``-byte substrings. Equal
   strings choose equal places, so only suffixes at such anchors are needed. Anchors seen in one document only are
   dropped (a pre-aggregated count, joined back).
2. ``marked``: all strings that hold an anchor lie in its *context* (``length - gram`` bytes before, ``length`` from
   it). Occurrences with the same context form a class, known by two 64-bit hashes; all but those in the class's first
   document are covered whole. Only the first document's occurrence of a class goes on, and only where the anchor has
   more classes than one.
3. ``sorted_matches``: those suffixes are range-partitioned by their leading bytes with splitters that Spark samples;
   each bucket is sorted by multikey quicksort (eight bytes a round, ties only) and the common prefixes of neighbours
   give, for every place of the string around its anchor, the runs of suffixes that share its right part; equal left
   parts in a run are one string, removed where its smallest document is smaller.
4. Runs that reach the first or last suffix of a bucket may go on in the next one. Their strings, one row for a string's
   smallest document in a bucket, are compared across boundaries by a second, map-side combined grouping. A hot passage
   can thus be cut anywhere.

Exact copies of whole documents are found by digest and are no part of steps 2 to 4.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweft.llm import common as c

LENGTH = 50
GRAM = 16
#: Suffixes of one bucket: 85 bytes each, so about 10 MB with their sort keys.
BUCKET_ROWS = 40_000


def _grams(texts: c.Texts, gram: int):
    rolling = c.byte_hashes(texts)
    grams = rolling.windows(gram)
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    valid = doc[:len(grams)] == doc[gram - 1:] if len(grams) else np.zeros(0, bool)
    return rolling, grams, doc, valid


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, context, doc_id, pos`` of every anchor; pos counts bytes."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in c.text_steps(batch.column("text")):
                rolling, grams, doc, valid = _grams(texts, gram)
                at, _ = c.anchor_positions(grams, valid, length - gram + 1)
                owner = doc[at]
                lo = np.maximum(at - (length - gram), texts.offsets[owner])
                hi = np.minimum(at + length, texts.offsets[owner + 1])
                context = c.mixed(rolling.spans(lo, hi) + (at - lo).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.signed(grams[at])), pa.array(c.signed(context)), pa.array(ids[first + owner]),
                     pa.array((at - texts.offsets[owner]).astype(np.int32))], ["key", "context", "doc_id", "pos"])
    return docs.select("doc_id", "text").mapInArrow(of, "key long, context long, doc_id long, pos int")


def marked(docs: DataFrame, copied: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, whole, open``: positions of anchors whose whole context is in a smaller document, and of the class
    representatives whose strings are still to be compared."""
    rows = anchors(docs, length, gram)
    again = c.written(rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                          .filter("a < b").select("key"), "anchors")
    kept = c.written(rows.join(again.hint("shuffle_hash"), "key")
                         .join(copied.select("doc_id"), "doc_id", "left_anti"), "shared-anchors")
    classes = c.written(kept.groupBy("key", "context").agg(F.min("doc_id").alias("first_doc")), "classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    verdicts = classes.join(several.withColumn("several", F.lit(True)), "key", "left")
    rows = (kept.join(verdicts, ["key", "context"])
                .withColumn("covered", F.col("first_doc") < F.col("doc_id")).filter("covered OR several"))
    return rows.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("covered"), F.col("pos")))).alias("whole"),
        F.sort_array(F.collect_list(F.when(~F.col("covered"), F.col("pos")))).alias("open"))


def suffixes(docs: DataFrame, marks: DataFrame, length: int, gram: int) -> DataFrame:
    """``suffix, before, doc_id, pos``: up to ``length`` bytes from an open anchor, and those before it."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in c.text_steps(batch.column("text")):
                rows = []
                for i in range(len(texts)):
                    at = batch.column("open")[first + i].as_py()
                    if at:
                        body, doc = texts.bytes_of(i), batch.column("doc_id")[first + i].as_py()
                        rows += [(body[p:p + length], body[max(0, p - length + gram):p], doc, p) for p in at]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, t) for col, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(),
                                                                         pa.int32()))],
                        ["suffix", "before", "doc_id", "pos"])
    picked = marks.filter(F.size("open") > 0).select("doc_id", "open")
    return docs.join(picked, "doc_id").select("doc_id", "text", "open").mapInArrow(
        of, "suffix binary, before binary, doc_id long, pos int")


def _padded(values: pa.Array, width: int, right: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a zero-padded matrix (aligned right if asked), and their lengths."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(values), width), np.uint8)
    row = np.repeat(np.arange(len(values)), sizes)
    inner = c.ranges(np.zeros(len(values), np.int64), sizes)
    out[row, inner + np.repeat(width - sizes, sizes) if right else inner] = data[c.ranges(offsets[:-1], sizes)]
    return out, sizes


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings: sorts by the leading eight bytes, then only ties by the next eight."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8")
    order = np.argsort(words[:, 0], kind="stable")
    same = words[order[1:], 0] == words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        tied = np.zeros(n, bool)
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        spots = np.flatnonzero(tied)
        group = np.cumsum(np.concatenate([[True], ~same]))[spots]
        part = order[spots]
        order[spots] = part[np.lexsort((words[part, k], group))]
        same &= words[order[1:], k] == words[order[:-1], k]
    return order


def bucket_matches(suffix: pa.Array, before: pa.Array, docs: np.ndarray, pos: np.ndarray, length: int, gram: int):
    """One bucket: (doc, start, end) of removed spans, and (string, doc, start) of those to compare across buckets."""
    right, right_size = _padded(suffix, length)
    left, left_size = _padded(before, length - gram, right=True)
    order = multikey_order(right)
    right, right_size, left, left_size = right[order], right_size[order], left[order], left_size[order]
    docs, pos = docs[order], pos[order]
    n, reach = len(docs), length - gram
    # common prefix of each suffix with the one before it
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    first = np.full(n, np.iinfo(np.int64).max)
    last = np.full(n, -1)
    across: list[tuple] = []
    left_hash = np.zeros(n, np.uint64)
    for o in range(reach + 1):
        if o:
            left_hash = c.mixed(left_hash + left[:, reach - o].astype(np.uint64) + np.uint64(o << 9))
        whole = np.flatnonzero((left_size >= o) & (right_size >= length - o))
        if not len(whole):
            continue
        block = np.concatenate([[0], np.cumsum(common < length - o)])
        whole = whole[np.lexsort((docs[whole], left_hash[whole], block[whole]))]
        new = np.ones(len(whole), bool)
        new[1:] = (block[whole[1:]] != block[whole[:-1]]) | (left_hash[whole[1:]] != left_hash[whole[:-1]])
        smallest = docs[whole[np.flatnonzero(new)]][np.cumsum(new) - 1]
        # a string's smallest document here may still have a smaller one in the next bucket
        edge = (smallest == docs[whole]) & ((block[whole] == 0) | (block[whole] == block[-1]))
        for i in whole[edge]:
            across.append((left[i, reach - o:].tobytes() + right[i, :length - o].tobytes(), int(docs[i]),
                           int(pos[i]) - o))
        gone = whole[smallest < docs[whole]]
        first[gone] = np.minimum(first[gone], pos[gone] - o)
        last[gone] = np.maximum(last[gone], pos[gone] - o + length)
    hit = np.flatnonzero(last >= 0)        # every span of a suffix holds its anchor, so their union is one span
    return (docs[hit], first[hit], last[hit]), across


def sorted_matches(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, start, stop`` of all removed spans around open anchors."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = [b for b in batches if b.num_rows]
        if not bucket:
            return
        table = pa.Table.from_batches(bucket).combine_chunks()
        col = {name: table.column(name).combine_chunks() for name in table.column_names}
        (docs, first, last), across = bucket_matches(
            col["suffix"], col["before"], col["doc_id"].to_numpy(), col["pos"].to_numpy().astype(np.int64), length, gram)
        names = ["doc_id", "start", "stop", "string"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(first), pa.array(last), pa.nulls(len(docs), pa.binary())], names)
        for lo in range(0, len(across), 10_000):
            part = across[lo:lo + 10_000]
            start = pa.array([x[2] for x in part], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[1] for x in part], pa.int64()), start,
                 pa.array([x[2] + length for x in part], pa.int64()), pa.array([x[0] for x in part], pa.binary())], names)

    found = c.written(rows.repartitionByRange(buckets, "suffix", "before")
                          .mapInArrow(of, "doc_id long, start long, stop long, string binary"), "suffix-matches")
    across = found.filter("string IS NOT NULL")
    least = across.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")) \
                  .filter("least < most").select("string", "least")
    return (found.filter("string IS NULL").select("doc_id", "start", "stop")
                 .unionByName(across.join(least, "string").filter("least < doc_id").select("doc_id", "start", "stop")))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_spans(docs: DataFrame, marks: DataFrame, spans: DataFrame, copied: DataFrame, length: int,
                 gram: int) -> DataFrame:
    """Each text without the bytes of its spans."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = (docs.join(marks.select("doc_id", "whole"), "doc_id", "left").join(per_doc, "doc_id", "left")
                  .join(copied.select("doc_id", F.lit(True).alias("copied")), "doc_id", "left"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(name) for name in batch.schema.names}
            for first, texts in c.text_steps(get["text"]):
                out = []
                for i in range(len(texts)):
                    k, body = first + i, texts.bytes_of(i)
                    n = len(body)
                    if get["copied"][k].as_py():
                        a, b = np.array([0]), np.array([n if n >= length else 0])
                    else:
                        whole = np.array(get["whole"][k].as_py() or [], np.int64)
                        a = np.concatenate([np.maximum(whole - (length - gram), 0),
                                            np.array(get["starts"][k].as_py() or [], np.int64)])
                        b = np.concatenate([np.minimum(whole + length, n),
                                            np.array(get["stops"][k].as_py() or [], np.int64)])
                    a, b = c.merged_spans(a, b)
                    a, b = a[b > a], b[b > a]
                    cuts = zip(np.concatenate([[0], b]).tolist(), np.concatenate([a, [n]]).tolist())
                    out.append((get["doc_id"][k].as_py(), n, int((b - a).sum()), len(a),
                                b"".join(body[x:y] for x, y in cuts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, t) for col, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                                    pa.binary()))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return joined.select("doc_id", "text", "whole", "starts", "stops", "copied").mapInArrow(of, _RESULT)


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each text's UTF-8 bytes without those in an earlier document.

    Overlaps count and strings are judged on the input. ``kept`` is binary, as a cut may fall inside a character.
    Null and empty texts, and texts under ``length`` bytes, lose nothing. Equal strings in documents with equal ids
    do not count (rows that repeat an id are one document, the greatest text); rows without an id are left out. An
    empty table gives an empty result; columns other than the two named are ignored.
    """
    c.prepare(docs.sparkSession)
    rows = c.keyed_documents(docs, id_col, text_col)
    copied = c.written(c.copies(rows), "copies")
    marks = c.written(marked(rows, copied, length, gram), "marks")
    spans = c.written(sorted_matches(c.written(suffixes(rows, marks, length, gram), "suffixes"), length, gram), "spans")
    return remove_spans(rows, marks, spans, copied, length, gram)
