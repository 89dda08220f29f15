"""The array splitter and its id table against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from logweft.llm import bpe_split, byte_words, common as c

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def steps(texts):
    return next(c.text_steps(pa.array(texts, pa.string()), 1 << 30))[1]


def words(texts):
    made = steps(texts)
    starts, odd = byte_words.word_starts(made)
    edges = [*starts.tolist(), len(made.data)]
    out = [[] for _ in texts]
    for a, b in zip(edges[:-1], edges[1:]):
        out[int(np.searchsorted(made.offsets, a, side="right")) - 1].append(made.data[a:b].tobytes().decode())
    return out, odd


def test_every_plain_character_splits_like_the_library():
    plain = [chr(x) for a, b in byte_words.PLAIN_RANGES for x in range(a, b + 1)]
    texts = ["".join(f"a{ch}b {ch}1{ch} {ch}{ch}'{ch} 's{ch}'" for ch in plain[k:k + 200]) for k in range(0, len(plain), 200)]
    got, odd = words(texts)
    assert not odd.any()
    assert got == [bpe_split.library_words(BYTE, t) for t in texts]


def test_random_texts_split_like_the_library():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t ", "a", "I", "'", "'s", "'re", "'ve", "'ll", "'d", "'m", "'t", "1", "!", "é", "ж", "漢", " ", "v", "l"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    got, odd = words(texts)
    assert not odd.any()
    assert got == [bpe_split.library_words(BYTE, t) for t in texts]


def test_ids_equal_the_library(rows):
    tok = Tokenizer.from_file(BYTE)
    texts = [t or "" for _, t in rows] + ["\U0001f600 ok", "العربية", "", "x" * 5000, "<|endoftext|>a"]
    refused = np.array(["<|endoftext|>" in t for t in texts])
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    for limit in (400_000, 60):
        byte_words.byte_table.cache_clear()
        byte_words.byte_table(BYTE).limit = limit
        for batch in (texts, texts[::-1]):
            bad = refused if batch is texts else refused[::-1]
            ids, bounds = byte_words.encode_texts(steps(batch), BYTE, encode, bad)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encode(t) for t in batch]
    byte_words.byte_table.cache_clear()
    ids, bounds = byte_words.encode_texts(steps(["", ""]), BYTE, encode)
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]


def test_a_full_table_keeps_the_words_met_again():
    asked = []
    table = byte_words.IdTable(lambda words: asked.extend(words) or [[len(w), ord(w[0])] for w in words], limit=60)
    often = [f"often{i}" for i in range(10)]
    for step in range(12):
        words = often + [f"once{step}-{i}" for i in range(15)]
        got = steps(words)
        ids, sizes = table.ids_of(got, got.offsets[:-1], got.offsets[1:])
        assert sizes.tolist() == [2] * len(words) and ids.reshape(-1, 2).tolist() == [[len(w), ord(w[0])] for w in words]
        assert len(table.keys) <= 60
    assert all(asked.count(w) == 1 for w in often) and len(asked) == 10 + 12 * 15
