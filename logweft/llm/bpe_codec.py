"""BPE encoding and decoding through a table of distinct words.

1. ``word_blocks``: words are split in generated code. A task turns runs of documents into blocks: the distinct words
   of the block, and the documents as packed sequences of places in that list. A word that a block repeats a thousand
   times is one row from here on.
2. ``word_table``: each distinct word of the corpus is encoded once (``distinct`` combines map-side) and its ids are
   decoded through a join with the id-to-piece table, which is as large as the vocabulary and broadcast.
3. ``packed_lookups`` and ``coded_blocks``: the blocks' words are joined with the word table and go back to their block
   by place, packed; a block's words and its sequences meet, and every document's ids and decoded text are the looked-up
   parts in order. The blocks are a table bucketed by block, so only the packed words are shuffled for that.

Blocks are bounded by ``BLOCK_WORDS`` (a longer document is a block of its own). Texts with special tokens, or with
characters beyond the plain set, are split by the library itself and take the same way from there.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from logweft.llm import bpe_split as bs
from logweft.llm import common as c

BLOCK_WORDS = 8_000_000
#: Looked-up words that a task packs at a time on their way back to the blocks.
PACK_ROWS = 200_000
#: Level of zstd for what lies in the blocks and lookups, which are most of what the job holds on disk.
LEVEL = 9

_BLOCK = ("block long, doc_ids array<long>, sizes array<int>, words array<string>, places binary")


def packed_places(places: np.ndarray) -> bytes:
    """Unsigned 32-bit places as compressed byte planes."""
    planes = np.ascontiguousarray(places.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes, LEVEL)


def unpacked_places(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def word_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, block_words: int) -> DataFrame:
    specials = list(bs.special_tokens(path))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = bs.is_plain(text, specials)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.when(plain, bs.split_words(F.lower(text), bs.WORD_SPLIT)).alias("words"),
                       F.when(~plain, text).alias("odd"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        ids, sizes, places, held = [], [], [], 0

        def block():
            # frequent words get small places, which pack better; the batches' places are counted and ranked one by one
            counts = np.zeros(len(words), np.int64)
            for own in places:
                counts += np.bincount(own, minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(words), "<u4")
            rank[order] = np.arange(len(words), dtype="<u4")
            joined = np.zeros(held, "<u4")
            at = held
            while places:
                own = places.pop()
                at -= len(own)
                joined[at:at + len(own)] = rank[own]
            listed = pa.array(list(words), pa.string()).take(pa.array(order))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                 pa.array([packed_places(joined)], pa.binary())],
                ["block", "doc_ids", "sizes", "words", "places"])

        for batch in batches:
            own = batch.column("words")
            odd = batch.column("odd")
            if odd.null_count < len(odd):
                own = pa.array([bs.library_words(path, o) if o is not None else w
                                for o, w in zip(odd.to_pylist(), own.to_pylist())], pa.list_(pa.string()))
            coded = own.flatten().dictionary_encode()
            slot = np.array([words.setdefault(w, len(words)) for w in coded.dictionary.to_pylist()], "<u4")
            ids += batch.column("doc_id").to_pylist()
            sizes += np.diff(own.offsets.to_numpy()).tolist()
            places.append(slot[coded.indices.to_numpy()] if len(slot) else slot)
            held += len(places[-1])
            if held >= block_words:
                yield block()
                number, words, ids, sizes, places, held = number + 1, {}, [], [], [], 0
        if ids:
            yield block()
    return rows.mapInArrow(of, _BLOCK)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece`` of every token: as many rows as the vocabulary."""
    tok = bs.tokenizer(path)
    return spark.createDataFrame([(i, p) for p, i in tok.get_vocab(with_added_tokens=True).items()],
                                 "id int, piece string")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """``word, ids, pieces`` (pieces joined by a blank) for distinct ``word`` rows."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, specials = bs.tokenizer(path), bs.special_tokens(path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = [[specials[w]] if w in specials else [t.id for t in tok.model.tokenize(bs.to_byte_level(w))]
                   for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])
    encoded = words.mapInArrow(of, "word string, ids array<int>")
    pieces = F.broadcast(piece_table(words.sparkSession, path))      # bounded by the vocabulary
    decoded = (encoded.select("word", F.posexplode("ids").alias("k", "id")).join(pieces, "id")
                      .groupBy("word").agg(F.sort_array(F.collect_list(F.struct("k", "id", "piece"))).alias("t")))
    return decoded.select("word", F.col("t.id").alias("ids"), F.array_join("t.piece", " ").alias("pieces"))


def bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks as a table bucketed by block (written once, no shuffle)."""
    return c.bucketed_table(blocks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", compression="zstd")


def packed_lookups(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """``home, places, counts, ids, pieces``: for a block, packed runs of its words' places, numbers of ids, ids and
    pieces (the last two as lines)."""
    listed = blocks.select(F.col("block").alias("home"), F.posexplode("words").alias("place", "word"))
    found = listed.join(table, "word").select("home", "place", F.array_join("ids", " ").alias("ids"),
                                              F.size("ids").alias("n"), "pieces")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packs():
            run = pa.Table.from_batches(held).sort_by([("home", "ascending"), ("place", "ascending")])
            home = run.column("home").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = run.slice(a, b - a)
                lines = [zstandard.compress("\n".join(part.column(x).to_pylist()).encode(), LEVEL) for x in ("ids", "pieces")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([home[a]], pa.int64()), pa.array([packed_places(part.column("place").to_numpy())], pa.binary()),
                     pa.array([packed_places(part.column("n").to_numpy())], pa.binary()),
                     pa.array(lines[:1], pa.binary()), pa.array(lines[1:], pa.binary())],
                    ["home", "places", "counts", "ids", "pieces"])
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packs()
                held, n = [], 0
        if n:
            yield from packs()
    return found.mapInArrow(of, "home long, places binary, counts binary, ids binary, pieces binary")


def coded_blocks(blocks: DataFrame, lookups: DataFrame, schema: str,
                 per_document: Callable[[int, list[str], list[str]], tuple]) -> DataFrame:
    """One row per document: its id, then what ``per_document`` makes of the number of its ids and of the ids and pieces
    of its words (blank-joined strings)."""
    fields = T._parse_datatype_string(schema)

    def lines(packed: bytes) -> list[str]:
        return zstandard.decompress(packed).decode().split("\n")

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.concatenate([np.zeros(0, np.int64), *map(unpacked_places, right.column("places").to_pylist())])
        order = np.argsort(place, kind="stable")
        sizes = np.concatenate([np.zeros(0, np.int64), *map(unpacked_places, right.column("counts").to_pylist())])[order]
        ids, pieces = (np.array([x for packed in right.column(name).to_pylist() for x in lines(packed)], object)[order]
                       for name in ("ids", "pieces"))
        rows = []
        for row in range(left.num_rows):
            places = unpacked_places(left.column("places")[row].as_py())
            ends = np.concatenate([[0], np.cumsum(np.array(left.column("sizes")[row].as_py(), np.int64))]).astype(np.int64)
            for doc, a, b in zip(left.column("doc_ids")[row].as_py(), ends[:-1], ends[1:]):
                own = places[a:b]
                rows.append((doc, *per_document(int(sizes[own].sum()), ids[own].tolist(), pieces[own].tolist())))
        arrow = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
        cols = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.table([pa.array(list(col), t) for col, t in zip(cols, arrow)], names=[f.name for f in fields])

    return blocks.select("block", "doc_ids", "sizes", "places").groupBy("block").cogroup(lookups.groupBy("home")) \
                 .applyInArrow(of, schema)


def _texts(n: int, ids: list[str], pieces: list[str]) -> tuple:
    return n, " ".join(ids), " ".join(pieces)


def _digests(n: int, ids: list[str], pieces: list[str]) -> tuple:
    return (n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(pieces).encode()).hexdigest())


def encode_decode(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text",
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per input row: decimal ids joined by a blank, and the decoded text.

    With ``digests`` the last two are ``ids_sha256, decoded_sha256``, formed where the text is, so that neither leaves
    its task, and written at once, so that no table stays but the result. As the library does without added special tokens: special tokens written out in a text are encoded as
    such. For a vocabulary that has no decoder, decoding joins the pieces by a blank. Null texts are empty: no tokens,
    empty strings. Repeated rows give repeated results, null ids stay null, other columns are ignored, and an empty
    table gives an empty result.
    """
    c.prepare(docs.sparkSession)
    blocks = bucketed(word_blocks(docs, path, id_col, text_col, block_words))
    words = blocks.select(F.explode("words").alias("word")).distinct()
    coded = c.written(word_table(words, path), "word-table", compression="zstd")
    table = c.written(packed_lookups(blocks, coded), "lookups")
    c.removed(coded)
    if not digests:
        return coded_blocks(blocks, table, "doc_id long, n_tokens long, ids string, decoded string", _texts)
    made = c.written(coded_blocks(blocks, table, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests), "digests")
    c.removed(table)
    c.dropped(blocks)
    return made
