"""Token-id output as wavelet-matrix shards.

Documents are range-partitioned and sorted by id, encoded, and written as shards: a Parquet table with one row (and one
file) per shard, holding one compressed file image. The image is a wavelet matrix: one succinct bit-plane per bit of the
id, high bits first, each a stable partition of the one before by that bit. Planes are compressed in blocks, and the
image's head holds each block's place and the set bits before it, so that rank and select read one block a plane: a
token at a place, the number of a token in a span and the places of a token come from a few blocks, without the ids ever
being stored as such. The documents' ids and lengths are a section of the same image.

Texts are cut into words with array operations, and a worker encodes each distinct word once (``byte_words``, a bounded
table). Positions of shards in the corpus come from a sum over the written shards, not from a global sort.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logweft.llm import bpe_split as bs
from logweft.llm import byte_words as bw
from logweft.llm import common as c
from logweft.operators.numbering import range_partitions

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Bits of one block of a plane.
BLOCK_BITS = 1 << 15
#: Blocks that an opened image keeps.
_KEPT = 64
_MAGIC = b"WVM2"


def _documents_section(doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    return zstandard.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes(), 1)


class Wavelet:
    """A sequence of unsigned integers as bit-planes with rank and select, in memory (``of``) or in an image (``open``).

    ``blocks_read`` counts the blocks that were taken out of an image.
    """

    def __init__(self, n: int, bits: int, ones: np.ndarray):
        self.n, self.bits, self.ones = n, bits, ones       # ones[k, b]: set bits of plane k before block b
        self.zeros = [n - int(x) for x in ones[:, -1]]
        self.planes: list[np.ndarray] = []
        self.blocks_read = 0

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> "Wavelet":
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        ids = np.array(ids, np.uint16 if bits <= 16 else np.uint32)
        spare = np.empty_like(ids)                    # planes go to and fro between two arrays
        planes, ones = [], np.zeros((bits, -(-len(ids) // BLOCK_BITS) + 1), np.int64)
        for k in range(bits):
            on = (ids >> ids.dtype.type(bits - 1 - k) & ids.dtype.type(1)).astype(bool)
            planes.append(np.packbits(on))
            if len(on):
                np.cumsum(np.add.reduceat(on, np.arange(0, len(on), BLOCK_BITS), dtype=np.int64), out=ones[k, 1:])
            zeros = len(ids) - int(ones[k, -1])
            np.compress(~on, ids, out=spare[:zeros])
            np.compress(on, ids, out=spare[zeros:])
            ids, spare = spare, ids
        made = cls(len(ids), bits, ones)
        made.planes = planes
        return made

    # ---- image
    def to_bytes(self, doc_ids=(), sizes=()) -> bytes:
        """Head (counts), set bits before each block, places of the blocks, documents, blocks."""
        packer = zstandard.ZstdCompressor(level=1)
        step = BLOCK_BITS // 8
        blocks = [packer.compress(plane[lo:lo + step]) for plane in self.planes for lo in range(0, len(plane), step)]
        docs = _documents_section(doc_ids, sizes)
        places = np.concatenate([[0], np.cumsum([len(x) for x in blocks], dtype=np.int64)])
        head = np.array([self.n, self.bits, BLOCK_BITS, len(doc_ids), len(docs)], "<u8").tobytes()
        return b"".join([_MAGIC, head, self.ones.astype("<i8").tobytes(), places.astype("<i8").tobytes(), docs, *blocks])

    @classmethod
    def open(cls, image: bytes) -> "Wavelet":
        """The sequence of an image; blocks are read when they are asked for."""
        if image[:4] != _MAGIC:
            raise ValueError("no wavelet shard")
        n, bits, block_bits, n_docs, docs_size = (int(x) for x in np.frombuffer(image, "<u8", 5, 4))
        across, at = -(-n // block_bits), 44
        ones = np.frombuffer(image, "<i8", bits * (across + 1), at).reshape(bits, across + 1)
        at += ones.nbytes
        made = cls(n, bits, ones)
        made._places = np.frombuffer(image, "<i8", bits * across + 1, at)
        made._docs_at, made._n_docs = at + made._places.nbytes, n_docs
        made._body_at, made._block_bits = made._docs_at + docs_size, block_bits
        made._image, made._kept = image, {}
        return made

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the image's documents and their lengths."""
        raw = np.frombuffer(zstandard.decompress(self._image[self._docs_at:self._body_at]), "<i8")
        return raw[:self._n_docs], raw[self._n_docs:]

    def _block(self, k: int, b: int) -> np.ndarray:
        """Packed bits of a block of plane k."""
        if self.planes:
            return self.planes[k][b * BLOCK_BITS // 8:(b + 1) * BLOCK_BITS // 8]
        place = k * (self.ones.shape[1] - 1) + b
        if place not in self._kept:
            if len(self._kept) >= _KEPT:
                self._kept.pop(next(iter(self._kept)))
            lo, hi = self._places[place:place + 2] + self._body_at
            self._kept[place] = np.frombuffer(zstandard.decompress(self._image[lo:hi]), np.uint8)
            self.blocks_read += 1
        return self._kept[place]

    def _span(self) -> int:
        return BLOCK_BITS if self.planes else self._block_bits

    # ---- rank and select
    def _bit(self, k: int, i: int) -> int:
        b, i = divmod(i, self._span())
        return int(self._block(k, b)[i // 8]) >> (7 - i % 8) & 1

    def _ones(self, k: int, i: int) -> int:
        """Set bits of plane k before place i."""
        b, i = divmod(i, self._span())
        total = int(self.ones[k, b])
        if i:
            block = self._block(k, b)
            total += int(np.bitwise_count(block[:i // 8]).sum())
            if i % 8:
                total += (int(block[i // 8]) >> (8 - i % 8)).bit_count()
        return total

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            on = self._bit(k, i)
            value = value << 1 | on
            i = self.zeros[k] + self._ones(k, i) if on else i - self._ones(k, i)
        return value

    def _narrow(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``value`` occurs in places lo .. hi - 1 (rank is ``count(value, 0, i)``)."""
        a, b = self._narrow(value, lo, self.n if hi is None else hi)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of ``value``."""
        lo, hi = self._narrow(value, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(self.bits - 1, -1, -1):
            on = value >> (self.bits - 1 - k) & 1
            i = self._place_of(k, on, i - self.zeros[k] if on else i)
        return i

    def _place_of(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth such bit of plane k."""
        span = self._span()
        before = self.ones[k] if bit else np.minimum(np.arange(self.ones.shape[1]) * span, self.n) - self.ones[k]
        b = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self._block(k, b), count=min(span, self.n - b * span))
        return b * span + int(np.flatnonzero(bits == bit)[nth - int(before[b])])

    def places(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def _plane(self, k: int) -> np.ndarray:
        if self.planes:
            return self.planes[k]
        across = self.ones.shape[1] - 1
        at = self._places[k * across:(k + 1) * across + 1] + self._body_at
        self.blocks_read += across
        read = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join([read(self._image[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]), np.uint8)

    def decode(self) -> np.ndarray:
        """The whole sequence: the partitions undone from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self._plane(k), count=self.n).astype(bool)
            out = np.empty(self.n, kind)
            out[~on] = values[:self.zeros[k]]
            out[on] = values[self.zeros[k]:] | kind(1 << (self.bits - 1 - k))
            values = out
        return values


_SHARD = "part int, shard int, n_tokens long, image binary"


def write_shards(docs: DataFrame, path: str, end_id: int | None = END_ID, shard_tokens: int = SHARD_TOKENS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents in ascending id order; gives the table of shards (one row and file each).

    A shard takes documents until it holds ``shard_tokens`` ids; a longer document is a shard of its own. Null texts are
    empty (the end id alone), rows without an id are left out, rows that repeat an id are one document (the greatest
    text), other columns are ignored, and an empty table gives no shards.
    """
    c.prepare(docs.sparkSession)
    specials = [x.encode() for x in bs.special_tokens(path)]
    rows = c.keyed_documents(docs, id_col, text_col)
    rows = rows.repartitionByRange(range_partitions(rows), "doc_id").sortWithinPartitions("doc_id")
    bits = max(1, (max(bs.tokenizer(path).get_vocab_size() - 1, end_id or 0)).bit_length())
    kind = np.uint16 if bits <= 16 else np.uint32

    def with_specials(texts: c.Texts) -> np.ndarray:
        """Documents that hold the string of a special token: the library reads it as that token."""
        found, body = np.zeros(len(texts), bool), texts.data.tobytes()
        for special in specials:
            at = body.find(special)
            while at >= 0:
                found[np.searchsorted(texts.offsets, at, side="right") - 1] = True
                at = body.find(special, at + 1)
        return found

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        whole = lambda text: bs.tokenizer(path).encode(text, add_special_tokens=False).ids
        end = np.zeros(0, kind) if end_id is None else np.array([end_id], kind)
        ids, parts, held = [], [], 0

        def image() -> pa.RecordBatch:
            sizes = [len(p) for p in parts]
            made = Wavelet.of(np.concatenate(parts), bits).to_bytes(ids, sizes)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                                               pa.array([held], pa.int64()), pa.array([made], pa.binary())],
                                              ["part", "shard", "n_tokens", "image"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in c.text_steps(batch.column("text")):
                coded, bounds = bw.encode_texts(texts, path, whole, with_specials(texts))
                coded = coded.astype(kind)
                for i in range(len(texts)):
                    ids.append(doc_ids[first + i])
                    parts.append(np.concatenate([coded[bounds[i]:bounds[i + 1]], end]))
                    held += len(parts[-1])
                    if held >= shard_tokens:
                        yield image()
                        shard, ids, parts, held = shard + 1, [], [], 0
        if ids:
            yield image()
    return c.written(rows.mapInArrow(of, _SHARD), "wavelet-shards", maxRecordsPerFile="1", compression="uncompressed")


def shard_starts(shards: DataFrame) -> DataFrame:
    """The shards with ``first``, the number of ids in all earlier shards. Sums run within a part of the writing job and
    over the parts; the latter are as many as that job had partitions."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, "part")
                   .select("part", "shard", (F.col("base") + F.col("inner")).alias("first")))
    return shards.join(firsts, ["part", "shard"])


def _documents(shards: DataFrame, column: str, schema: str, value) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``column`` of every document, with the count of an id in its shard; ``value``
    turns the ids of a shard and the documents' bounds into the column."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = Wavelet.open(batch.column("image")[i].as_py())
                doc_ids, sizes = matrix.documents()
                ends = np.concatenate([[0], np.cumsum(sizes)])
                first = batch.column("first")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids), pa.array(first + ends[:-1]), pa.array(sizes), value(matrix.decode(), ends),
                     pa.array(np.full(len(sizes), matrix.count(END_ID)))],
                    ["doc_id", "start", "n_tokens", column, "shard_end_ids"])
    return shard_starts(shards).select("first", "image").mapInArrow(
        of, f"doc_id long, start long, n_tokens long, {column} {schema}, shard_end_ids long")


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids, shard_end_ids`` of every document, read from the shards' images; the last column
    counts the end id in the document's shard (by rank)."""
    return _documents(shards, "ids", "array<long>", lambda ids, ends: pa.ListArray.from_arrays(
        pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64))))


def document_checksums(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard_end_ids`` read back from the shards: CRC-32 of the ids as
    little-endian u32."""
    def sums(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())
    return _documents(shards, "ids_crc32", "long", sums)
