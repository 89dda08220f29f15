"""Alignment of two tokenizers' ids over the same bytes.

Tokenizer A is a byte-level BPE, B a sentencepiece model; both see a blank and the text. The cumulative byte ends of a
document's tokens are the keys of two dictionaries, end to index; the keys that both hold, sorted, slice the two id
lists into groups of equal bytes, and the links of a slice are its pairs of tokens that end with it.

How often a pair of ids is linked is counted over the corpus. A task gathers documents into blocks of bounded size that
hold each linked pair once, with what each document has of it; so pairs are counted, and their counts come back, once a
block. The best count of a B id is a table of one row per B id (bounded by the vocabulary, broadcast).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from logweft.llm import bpe_split as bs
from logweft.llm import byte_words as bw
from logweft.llm import common as c

#: Links after which a block is full (a longer document is a block of its own).
BLOCK_LINKS = 1 << 19
_MARK = "▁"                       # sentencepiece's sign for a blank


class Vocabulary:
    """The bytes of each id, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[c.ranges(self.starts[ids], self.sizes[ids])]


@lru_cache(maxsize=2)
def _plain_tokenizer(path: str) -> Tokenizer:
    """The tokenizer with the strings of special tokens as ordinary text."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    return tok


@lru_cache(maxsize=2)
def a_vocabulary(path: str) -> Vocabulary:
    tok, back = bs.tokenizer(path), {ch: b for b, ch in enumerate(bs.byte_alphabet())}
    special = set(bs.special_tokens(path))
    pieces = [b""] * tok.get_vocab_size()
    for piece, i in tok.get_vocab().items():
        pieces[i] = piece.encode() if piece in special else bytes(back[ch] for ch in piece)
    return Vocabulary(pieces)


@lru_cache(maxsize=2)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def b_vocabulary(path: str) -> Vocabulary:
    model = _pieces(path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_MARK, " ").encode())
    return Vocabulary(pieces)


@lru_cache(maxsize=2)
def _units_are_apart(path: str) -> bool:
    """Whether no piece goes on past a word into blanks, so that texts may be encoded word by word (a word with the
    blanks before it)."""
    model = _pieces(path)
    return not any(_MARK in model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))


@lru_cache(maxsize=2)
def _unit_table(path: str) -> bw.IdTable:
    model = _pieces(path)
    blank = model.piece_to_id(_MARK)
    # the model puts a blank before a text; a unit brings its own
    return bw.IdTable(lambda units: [ids if unit != " " else [blank] for unit, ids in
                                     zip(units, model.encode([u[1:] for u in units], num_threads=1))])


def b_ids(texts: c.Texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of B for texts that begin with a blank (the one that B itself would add), and the documents' bounds."""
    data, odd = texts.data, np.full(len(texts), not _units_are_apart(path))
    blank = data == 0x20
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    mark = _MARK.encode()                # the model takes its sign in a text for a blank
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, int)
    odd[np.searchsorted(texts.offsets, at, side="right") - 1] = True
    return bw.coded_documents(texts, np.flatnonzero(begin), _unit_table(path), odd,
                              lambda text: _pieces(path).encode(text[1:], num_threads=1))


def _same_bytes(ids: np.ndarray, bounds: np.ndarray, words: Vocabulary, texts: c.Texts) -> np.ndarray:
    """Which documents' joined token bytes are the text's."""
    ends = np.concatenate([[0], np.cumsum(words.sizes[ids])])
    sizes, wanted = np.diff(ends[bounds]), np.diff(texts.offsets)
    same = sizes == wanted
    joined = words.bytes_of(ids)
    if same.all():
        wrong = np.flatnonzero(joined != texts.data)
    else:
        keep = np.repeat(same, sizes)
        wrong = np.flatnonzero(joined[keep] != texts.data[np.repeat(same, wanted)])
        kept = np.flatnonzero(same)
        owner = np.repeat(kept, wanted[kept])
        same[owner[wrong]] = False
        return same
    same[np.searchsorted(texts.offsets, wrong, side="right") - 1] = False
    return same


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends at which tokens of both end, ascending, and the index of the last token of each that ends there."""
    of_a = dict(zip(ends_a.tolist(), range(len(ends_a))))
    of_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
    both = sorted(of_a.keys() & of_b.keys())
    return (np.array(both, np.int64), np.fromiter((of_a[x] for x in both), np.int64, len(both)),
            np.fromiter((of_b[x] for x in both), np.int64, len(both)))


def slice_links(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked tokens of A and of B: in each slice all pairs that end with it (one pair, unless an id has
    no bytes)."""
    first_a, n_a = np.searchsorted(ends_a, cuts, "left"), np.searchsorted(ends_a, cuts, "right")
    first_b, n_b = np.searchsorted(ends_b, cuts, "left"), np.searchsorted(ends_b, cuts, "right")
    n_a, n_b = n_a - first_a, n_b - first_b
    at_a, each = c.ranges(first_a, n_a), np.repeat(n_b, n_a)
    return np.repeat(at_a, each), c.ranges(np.repeat(first_b, n_a), each)


class _Names:
    """Decimal ids with the sign that follows them, for joining groups in one go."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        self.table = np.array([f"{i}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)], object)

    def joined(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` for id lists whose groups end at the given indices."""
        code_a, code_b = a.astype(np.int64), b.astype(np.int64) + 2 * self.n_a
        code_a[last_a] += self.n_a
        code_b[last_b] += (len(self.table) - 2 * self.n_a) // 2
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first = np.cumsum(sizes_a + sizes_b) - sizes_a - sizes_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[c.ranges(first, sizes_a)] = code_a
        codes[c.ranges(first + sizes_a, sizes_b)] = code_b
        return "".join(self.table[codes].tolist())[:-1]


_BLOCK = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups array<string>, n_pairs array<long>, pair_at binary, pair_n binary, pairs array<long>, counts array<long>")
_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _blocks(rows: DataFrame, path_a: str, path_b: str, digests: bool, block_links: int) -> DataFrame:
    """Aligned blocks of ``doc_id, text`` (a blank and the text; null: none): see ``_BLOCK``. ``pair_at`` and ``pair_n``
    (uint32) name each document's distinct pairs in the block's list and how often it has them."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        words_a, words_b = a_vocabulary(path_a), b_vocabulary(path_b)
        names = _Names(len(words_a.sizes), len(words_b.sizes))
        whole = lambda text: _plain_tokenizer(path_a).encode(text, add_special_tokens=False).ids
        held: list[tuple] = []
        links = 0

        def gathered() -> pa.RecordBatch:
            n_pairs = np.array([len(x[6]) for x in held], np.int64)
            codes = np.concatenate([x[6] for x in held])
            times = np.concatenate([x[7] for x in held])
            pairs, at = np.unique(codes, return_inverse=True)
            counts = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
            cols = [[block], *[[[x[k] for x in held]] for k in range(6)], [n_pairs], [at.astype(np.uint32).tobytes()],
                    [times.astype(np.uint32).tobytes()], [pairs], [counts]]
            types = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(),
                     pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)],
                                              [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in c.text_steps(batch.column("text")):
                a, at_a = bw.encode_texts(texts, path_a, whole)
                b, at_b = b_ids(texts, path_b)
                good = _same_bytes(a, at_a, words_a, texts) & _same_bytes(b, at_b, words_b, texts) & (np.diff(texts.offsets) > 1)
                size_a, size_b = words_a.sizes[a], words_b.sizes[b]
                for i in range(len(texts)):
                    doc = doc_ids[first + i]
                    if not good[i]:
                        held.append((doc, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        continue
                    own_a, own_b = a[at_a[i]:at_a[i + 1]], b[at_b[i]:at_b[i + 1]]
                    ends_a, ends_b = np.cumsum(size_a[at_a[i]:at_a[i + 1]]), np.cumsum(size_b[at_b[i]:at_b[i + 1]])
                    cuts, last_a, last_b = common_ends(ends_a, ends_b)
                    groups = names.joined(own_a, own_b, last_a, last_b)
                    if digests:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    x, y = slice_links(ends_a, ends_b, cuts)
                    codes, times = np.unique(own_a[x].astype(np.int64) << 32 | own_b[y], return_counts=True)
                    held.append((doc, len(own_a), len(own_b), len(cuts), len(x), groups, codes, times))
                    links += len(codes)
                    if links >= block_links:
                        yield gathered()
                        held, links, block = [], 0, block + 1
        if held:
            yield gathered()
    return rows.mapInArrow(of, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: how often each pair of ids (A's in the upper 32 bits) is linked, and whether no other pair of its
    B id is linked more often."""
    pairs = c.written(blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
                            .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")), "pairs")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("top"))        # at most one row per id of B
    return pairs.withColumn("b", of_b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _answered(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``_ALIGNED`` from blocks and the counts of their pairs."""
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of", "at", "n", "best")

    def of(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = {x: block.column(x)[0] for x in block.column_names}
        at = answer.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = answer.column("n").to_numpy(), answer.column("best").to_numpy()
        pair, times = np.frombuffer(row["pair_at"].as_py(), np.uint32), np.frombuffer(row["pair_n"].as_py(), np.uint32).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(row["n_pairs"].values.to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(x[pair] * times)]) for x in (best, n)]
        return pa.table({**{x: row[y].values for x, y in (("doc_id", "doc_ids"), *((y, y) for y in ("n_a", "n_b", "n_groups", "n_links")))},
                         "n_best": sums[0][cuts[1:]] - sums[0][cuts[:-1]], "count_sum": sums[1][cuts[1:]] - sums[1][cuts[:-1]],
                         "groups": row["groups"].values})
    parts = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs", "pair_at", "pair_n")
    return parts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(of, _ALIGNED)


def align_documents(docs: DataFrame, path_a: str, path_b: str, digests: bool = False, block_links: int = BLOCK_LINKS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one row per input row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the decimal ids of A and B in order, a group for each stretch between byte ends
    that both have (``digests``: its SHA-256 instead, as lowercase hex). ``n_best`` counts the document's links whose pair
    is linked most often among all pairs of its B id (ties included), ``count_sum`` adds the counts of its links' pairs.

    Null and empty texts, and texts whose joined token bytes differ from a blank and the text (a model that normalises
    them, a text that holds the model's sign for a blank), have no tokens: zeros and an empty ``groups``. Repeated rows
    are counted one by one, null ids are passed on, an empty table gives an empty result, other columns are ignored.
    """
    c.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit(" "), F.col(text_col)).alias("text"))
    blocks = c.written(_blocks(rows, path_a, path_b, digests, block_links), "aligned-blocks", compression="zstd")
    return _answered(blocks, c.written(pair_counts(blocks), "pair-counts"))
