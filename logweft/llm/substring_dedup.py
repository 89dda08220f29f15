"""Substring deduplication over words with a compacted De Bruijn graph.

A *window* is ``k`` consecutive words of one document. Every window is an edge of the graph; its nodes are the runs of
``k - 1`` words at its ends. Edges that occur twice or more are the repeated text. Where a node has one way in and one
way out, in all of the corpus, the edges on its sides always occur together: such paths are compacted into one row by
a join, and only the head of a path is looked up again among the occurrences. Their source coordinates (document,
word position) are then verified against the texts by digest, and every occurrence but the first is removed.

Steps, each a Spark job over a written table:

1. ``repeated_anchors``: only windows whose smallest ``gram``-word hash (their anchor) is seen twice can repeat. The
   anchors are counted with a pre-aggregated ``groupBy`` and joined back, so that windows of unique text (most of a
   corpus) never become rows. Nothing is lost: equal windows have equal anchors.
2. ``edge_rows``: the windows with repeated anchors, each with the hash of the window after it.
3. ``repeated_edges``: one row per edge seen twice: its number, first coordinate, and what
   follows if that is always the same.
4. ``compact_paths``: an edge and the edge at its first coordinate + 1 are linked by a join; runs of links are paths.
5. ``path_occurrences`` and ``verified``: the occurrences of each path's head give all spans; spans whose words'
   digest differs from the first one's are not repeats (a hash collision) and are dropped.

Exact copies of a whole document are found first by digest and never become edges, however many there are. All
groupings combine map-side; all joins are plain equi-joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweft.llm import common as c

WINDOW_WORDS = 20
GRAM_WORDS = 5


def _document_grams(texts: c.Texts, gram: int):
    """Word spans, hashes of every ``gram`` words, whether they lie in one document, and the documents' bounds."""
    starts, ends, bounds = c.word_spans(texts)
    rolling = c.Rolling(c.word_hashes(texts, starts, ends))
    grams = rolling.windows(gram)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    valid = doc[:len(grams)] == doc[gram - 1:] if len(grams) else np.zeros(0, bool)
    return starts, ends, bounds, doc, rolling, grams, valid


def anchor_rows(docs: DataFrame, k: int, gram: int) -> DataFrame:
    """``key, doc_id, pos``: the anchors of all windows."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, texts in c.text_steps(batch.column("text")):
                _, _, bounds, doc, _, grams, valid = _document_grams(texts, gram)
                found, _ = c.anchor_positions(grams, valid, k - gram + 1)
                owner = doc[found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.signed(grams[found])), pa.array(ids[at + owner]),
                     pa.array((found - bounds[owner]).astype(np.int32))], ["key", "doc_id", "pos"])
    return docs.select("doc_id", "text").mapInArrow(of, "key long, doc_id long, pos int")


def repeated_anchors(docs: DataFrame, k: int, gram: int, copied: DataFrame) -> DataFrame:
    """``doc_id, at``: for each document that is no copy, the sorted positions of anchors seen twice or more."""
    rows = anchor_rows(docs, k, gram)
    again = c.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "anchors")
    return (rows.join(again.hint("shuffle_hash"), "key").join(copied.select("doc_id"), "doc_id", "left_anti")
                .groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("at")))


_EDGE = "edge long, doc_id long, pos int, after long"


def edge_rows(docs: DataFrame, anchors: DataFrame, k: int, gram: int) -> DataFrame:
    """One row for each window whose anchor repeats; ``after`` is the next window, 0 at a document's end."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _EDGE.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at_lists = batch.column("at")
            for first, texts in c.text_steps(batch.column("text")):
                _, _, bounds, doc, rolling, grams, valid = _document_grams(texts, gram)
                _, least = c.anchor_positions(grams, valid, k - gram + 1)
                if not len(least):
                    continue
                lists = at_lists.slice(first, len(texts))
                sizes = np.diff(lists.offsets.to_numpy())
                spots = lists.flatten().to_numpy() + np.repeat(bounds[:-1], sizes)
                hot = np.zeros(len(grams), bool)
                hot[spots] = True
                # a window counts if a position that holds its minimum is marked
                marked = np.unique(grams[hot])
                n = len(rolling.sums) - k
                least = least[:n]
                windows = rolling.windows(k)
                inside = doc[:n] == doc[k - 1:k - 1 + n]
                keep = np.flatnonzero(inside & np.isin(least, marked))
                edges = c.signed(windows)
                after = np.zeros(len(keep), np.int64)
                has = keep + k < bounds[doc[keep] + 1]
                after[has] = edges[keep[has] + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edges[keep]), pa.array(ids[first + doc[keep]]),
                     pa.array((keep - bounds[doc[keep]]).astype(np.int32)), pa.array(after)], names)
    return docs.join(anchors, "doc_id").select("doc_id", "text", "at").mapInArrow(of, _EDGE)


def repeated_edges(edges: DataFrame) -> DataFrame:
    """One row per edge seen twice or more: how often, its first coordinate, and the next edge if always the same."""
    return (edges.groupBy("edge")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"),
                      F.min("after").alias("after"), F.max("after").alias("other"))
                 .filter("n > 1")
                 .select("edge", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"),
                         F.when(F.col("after") == F.col("other"), F.col("after")).otherwise(F.lit(0)).alias("after")))


def compact_paths(graph: DataFrame) -> DataFrame:
    """Nonbranching paths: ``edge`` (the head), its first coordinate and ``length`` in edges.

    Edge b continues edge a if b comes after a every time and both occur equally often (so that a comes before b every
    time). Their first coordinates are then neighbours, so the link is an equi-join on coordinates, and a path is a run
    of links in one document.
    """
    ahead = graph.filter("after <> 0").select(F.col("first_doc"), (F.col("first_pos") + 1).alias("first_pos"),
                                              F.col("after").alias("edge"), "n", F.lit(True).alias("linked"))
    linked = (graph.join(ahead, ["first_doc", "first_pos", "edge", "n"], "left")
                   .withColumn("head_pos", F.when(F.col("linked").isNull(), F.col("first_pos"))))
    run = Window.partitionBy("first_doc").orderBy("first_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (linked.withColumn("head_pos", F.max("head_pos").over(run))
                  .groupBy("first_doc", "head_pos")
                  .agg(F.min_by("edge", "first_pos").alias("edge"), F.count(F.lit(1)).cast("int").alias("length"))
                  .select("first_doc", F.col("head_pos").alias("first_pos"), "edge", "length"))


def path_occurrences(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``edge, doc_id, pos, length, is_first`` for every occurrence of every path."""
    return (edges.select("edge", "doc_id", "pos").join(paths, "edge")
                 .select("edge", "doc_id", "pos", "length",
                         ((F.col("doc_id") == F.col("first_doc"))
                          & (F.col("pos") == F.col("first_pos"))).alias("is_first")))


def _spaced(texts: c.Texts):
    """The words with one blank after each, end to end; where each begins there; and the documents' bounds in words."""
    starts, ends, bounds = c.word_spans(texts)
    sizes = ends - starts + 1
    places = c.ranges(starts, sizes)
    stops = np.cumsum(sizes)
    places[stops - 1] = 0
    spaced = texts.data[places] if len(texts.data) else texts.data
    spaced[stops - 1] = 0x20
    return spaced, np.concatenate([[0], stops]), bounds


def verified(docs: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """``doc_id, pos, n_words`` of the occurrences whose words equal those at the path's first coordinate."""
    per_doc = occurrences.groupBy("doc_id").agg(
        *[F.collect_list(x).alias(x) for x in ("edge", "pos", "length", "is_first")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in c.text_steps(batch.column("text")):
                spaced, at, bounds = _spaced(texts)
                lists = {x: batch.column(x).slice(first, len(texts)) for x in ("edge", "pos", "length", "is_first")}
                sizes = np.diff(lists["pos"].offsets.to_numpy())
                doc = np.repeat(np.arange(len(texts)), sizes)
                pos = lists["pos"].flatten().to_numpy()
                words = lists["length"].flatten().to_numpy() + k - 1
                lo = bounds[doc] + pos
                digests = [hashlib.sha256(spaced[a:b]).digest() for a, b in zip(at[lo].tolist(), at[lo + words].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [lists["edge"].flatten(), batch.column("doc_id").slice(first, len(texts)).take(pa.array(doc)),
                     pa.array(pos), pa.array(words.astype(np.int32)), lists["is_first"].flatten(),
                     pa.array(digests, pa.binary())],
                    ["edge", "doc_id", "pos", "n_words", "is_first", "digest"])

    seen = c.written(docs.join(per_doc, "doc_id").select("doc_id", "text", "edge", "pos", "length", "is_first").mapInArrow(
        of, "edge long, doc_id long, pos int, n_words int, is_first boolean, digest binary"), "spans")
    source = seen.filter("is_first").select("edge", F.col("digest").alias("first_digest"))
    return (seen.filter("NOT is_first").join(source, "edge").filter("digest = first_digest")
                .select("doc_id", "pos", "n_words"))


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def remove_spans(docs: DataFrame, spans: DataFrame, copied: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words outside all spans, joined by one space."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_list("pos").alias("at"), F.collect_list("n_words").alias("sizes"))
    joined = (docs.join(per_doc, "doc_id", "left")
                  .join(copied.select("doc_id", F.lit(True).alias("copied")), "doc_id", "left"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in c.text_steps(batch.column("text")):
                spaced, at, bounds = _spaced(texts)
                counts = np.diff(bounds)
                part = slice(first, first + len(texts))
                whole = batch.column("copied").fill_null(False).to_numpy(zero_copy_only=False)[part] & (counts >= k)
                lists = batch.column("at").slice(first, len(texts)).fill_null([])
                doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                lo = bounds[doc] + lists.flatten().to_numpy()
                depth = np.zeros(len(at), np.int64)
                np.add.at(depth, lo, 1)
                np.add.at(depth, lo + batch.column("sizes").slice(first, len(texts)).fill_null([]).flatten().to_numpy(), -1)
                keep = (np.cumsum(depth[:-1]) == 0) & ~np.repeat(whole, counts)
                left = np.diff(np.concatenate([[0], np.cumsum(keep)])[bounds])
                picked = np.flatnonzero(keep)
                sizes = at[picked + 1] - at[picked]
                body = spaced[c.ranges(at[picked], sizes)]
                stop = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(left)])]
                kept = [body[a:max(a, b - 1)].tobytes().decode() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(counts), pa.array(counts - left),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    return joined.select("doc_id", "text", "at", "sizes", "copied").mapInArrow(of, _RESULT)


def dedup_substrings(docs: DataFrame, k: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows that start earlier.

    A window starts earlier if the same ``k`` words start in a document with a smaller id, or before it in the same
    document; windows are judged on the input. Null and empty texts, and texts of fewer than ``k`` words, lose
    nothing (no words: ``kept`` is empty). Rows without an id are left out, rows that repeat an id are one document
    (the greatest text). An empty table gives an empty result; columns other than the two named are ignored.
    """
    spark = c.prepare(docs.sparkSession)
    rows = c.keyed_documents(docs, id_col, text_col)
    copied = c.written(c.copies(rows), "copies")
    anchors = c.written(repeated_anchors(rows, k, gram, copied), "anchor-lists")
    edges = c.written(edge_rows(rows, anchors, k, gram), "edges")
    paths = c.written(compact_paths(c.written(repeated_edges(edges), "graph")), "paths")
    occurrences = c.written(path_occurrences(edges, paths), "occurrences")
    spans = c.written(verified(rows, occurrences, k), "verified")
    return remove_spans(rows, spans, copied, k)
