import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweft.llm import bpe_codec, bpe_split, wavelet_shards

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", None, " ", "\n\n  x\t y  ", "Hello, WORLD's 12345 they'll don't I'M", "<|endoftext|>a <|startoftext|> b<|endoftext|>",
       "é café İstanbul ΣΟΣ ẞ K", "日本語テキスト と カタカナ が が", "한국어 텍스트 123", "\U0001f600 \U0001f468‍\U0001f469 ok",
       "العربية हिन्दी ไทย", "a b c d　e\x85f\x1cg\x0bh", "Ǆǅ ŉ ﬁ ½ ² Ⅳ ٣ ৪", "x" * 5000, "'s 't 're've'm'll'd 'S 'LL", "tab\tsep  two   three    four\n",
       "<|endoftext|>", "endoftext|>", "Ошибка в РОССИИ ё й", "a\u0000b ﻿ �"]


@pytest.fixture(scope="module")
def odd_texts(spark, rows):
    return spark.createDataFrame(list(enumerate(ODD + [t for _, t in rows])), "doc_id long, text string").repartition(3)


def test_generated_code_splits_like_the_library(spark):
    """Every character of the plain set, between letters and alone, and every white space."""
    plain = [chr(x) for a, b in ((0, 0x24F), (0x400, 0x482), (0x48A, 0x4FF), (0x2010, 0x2027), (0x3041, 0x3096),
                                 (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)) for x in range(a, b + 1)]
    texts = ["".join(f"a{ch}b {ch}1{ch} {ch}{ch}'{ch}" for ch in plain[k:k + 200]) for k in range(0, len(plain), 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", bpe_split.is_plain(F.col("text"), []).alias("plain"),
                    bpe_split.split_words(F.lower("text"), bpe_split.WORD_SPLIT).alias("w"),
                    bpe_split.split_words(F.col("text"), bpe_split.BYTE_SPLIT).alias("b")).collect()
    for r in got:
        assert r.plain
        assert r.w == bpe_split.library_words(WORD, texts[r.doc_id])
        assert r.b == bpe_split.library_words(BYTE, texts[r.doc_id])


@pytest.mark.parametrize("block_words", [4_000_000, 50])
def test_word_codec(odd_texts, block_words):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe_codec.encode_decode(odd_texts, WORD, block_words=block_words).collect()}
    for i, text in [(r.doc_id, r.text or "") for r in odd_texts.collect()]:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids) == (len(ids), " ".join(map(str, ids))), text
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_word_codec_digests_and_odd_rows(odd_texts, odd_docs, no_docs):
    full = {r.doc_id: r for r in bpe_codec.encode_decode(odd_texts, WORD).collect()}
    for r in bpe_codec.encode_decode(odd_texts, WORD, digests=True).collect():
        assert r.ids_sha256 == hashlib.sha256(full[r.doc_id].ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(full[r.doc_id].decoded.encode()).hexdigest()
    got = bpe_codec.encode_decode(odd_docs, WORD).collect()
    assert len(got) == 8 and sum(r.n_tokens == 0 for r in got) == 3 and sum(r.doc_id is None for r in got) == 2
    assert bpe_codec.encode_decode(no_docs, WORD).count() == 0


def test_shards_round_trip(odd_texts):
    tok = Tokenizer.from_file(BYTE)
    shards = wavelet_shards.write_shards(odd_texts, BYTE, shard_tokens=3000)
    assert shards.count() > 5
    got = {r.doc_id: r for r in wavelet_shards.document_checksums(shards).collect()}
    whole = {r.doc_id: r for r in wavelet_shards.read_documents(shards).collect()}
    start = 0
    for i, text in sorted((r.doc_id, r.text or "") for r in odd_texts.collect()):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), text
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (whole[i].start, whole[i].ids) == (start, ids)
        start += len(ids)
    assert all(r.shard_end_ids == got[r.doc_id].shard_end_ids >= 1 for r in whole.values())


def test_shards_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id, r.n_tokens) for r in
                 wavelet_shards.document_checksums(wavelet_shards.write_shards(odd_docs, BYTE)).collect())
    assert [i for i, _ in got] == [1, 2, 3, 4] and got[3] == (4, 1)
    assert wavelet_shards.document_checksums(wavelet_shards.write_shards(no_docs, BYTE)).count() == 0


def test_wavelet_access_count_select():
    rng = np.random.default_rng(4)
    for n, top in ((0, 5), (1, 1), (7, 2), (513, 50), (5000, 60000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        made = wavelet_shards.Wavelet.of(ids, 16)
        w = wavelet_shards.Wavelet.open(made.to_bytes())
        assert (made.decode() == ids).all() and made.count(3) == w.count(3) == int((ids == 3).sum())
        assert (w.decode() == ids).all()
        for i in rng.integers(0, n, 30) if n else []:
            value = int(ids[i])
            assert w.access(int(i)) == value
            assert w.count(value, 0, int(i)) == int((ids[:i] == value).sum())
            assert w.count(value) == int((ids == value).sum())
            assert w.places(value)[:20] == np.flatnonzero(ids == value)[:20].tolist()
            assert w.select(value, w.count(value, 0, int(i))) == i
        assert w.count(65535) == 0 and w.count(1 << 20) == 0
        with pytest.raises(IndexError):
            w.access(n)


def test_an_opened_image_reads_few_blocks():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.3, 1 << 20).clip(0, 50_000).astype(np.uint32)
    image = wavelet_shards.Wavelet.of(ids, 16).to_bytes([5, 9], [len(ids) - 7, 7])
    for ask in (lambda w: w.access(777_777) == ids[777_777],
                lambda w: w.count(17, 100_000, 900_000) == int((ids[100_000:900_000] == 17).sum()),
                lambda w: w.select(17, 4000) == np.flatnonzero(ids == 17)[4000]):
        w = wavelet_shards.Wavelet.open(image)
        assert ask(w) and 0 < w.blocks_read <= 3 * w.bits
    assert [x.tolist() for x in w.documents()] == [[5, 9], [len(ids) - 7, 7]]
    with pytest.raises(ValueError):
        wavelet_shards.Wavelet.open(b"WVM1" + image[4:])


def test_wide_ids_and_odd_shard_ends():
    ids = np.array([0, 70_000, 3, 70_000, 1 << 17], np.uint32)
    w = wavelet_shards.Wavelet.open(wavelet_shards.Wavelet.of(ids).to_bytes())
    assert w.decode().tolist() == ids.tolist() and [w.access(i) for i in range(5)] == ids.tolist() and w.places(70_000) == [1, 3]


def test_packed_places_are_smaller_than_at_the_first_level():
    import zstandard
    rng = np.random.default_rng(3)
    places = np.minimum(rng.zipf(1.2, 300_000), 60_000)
    packed = bpe_codec.packed_places(places)
    assert (bpe_codec.unpacked_places(packed) == places).all()
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    assert len(packed) < len(zstandard.compress(planes.tobytes(), 1))


def test_places_of_a_block_are_held_in_32_bits():
    """Packing takes one copy beside the packed bytes, unpacking gives 32-bit places."""
    import tracemalloc
    places = (np.arange(2_000_000) % 50).astype("<u4")
    tracemalloc.start()
    packed = bpe_codec.packed_places(places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * places.nbytes, peak
    out = bpe_codec.unpacked_places(packed)
    assert out.dtype.itemsize == 4 and (out == places).all()
