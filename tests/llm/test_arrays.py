import re

import numpy as np
import pyarrow as pa

from logweft.llm import common as c

TEXTS = ["one two  three", None, "", "\x0bé\x1cx y\n", "a", " b "]


def test_words_match_the_pattern():
    for step in (1, 8, 1 << 20):
        found = []
        for _, texts in c.text_steps(pa.array(TEXTS), step):
            starts, ends, bounds = c.word_spans(texts)
            words = [texts.data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
            found += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_span_hashes_depend_on_content_only():
    _, texts = next(c.text_steps(pa.array(["abcab", "xxabc"])))
    h = c.byte_hashes(texts).spans(np.array([0, 3, 7, 7]), np.array([2, 5, 9, 10]))
    assert h[0] == h[1] == h[2] != h[3]
    assert c.byte_hashes(texts).windows(2)[0] == h[0]


def test_every_window_names_its_minimum():
    rng = np.random.default_rng(1)
    grams = rng.integers(1, 50, 300).astype(np.uint64)
    valid = rng.random(300) > 0.05
    for width in (1, 2, 5, 8):
        at, least = c.anchor_positions(grams, valid, width)
        named = set(at.tolist())
        wanted = set()
        for i in range(300 - width + 1):
            if valid[i:i + width].all():
                low = grams[i:i + width].min()
                assert least[i] == low
                wanted |= {i + j for j in range(width) if grams[i + j] == low}
            else:
                assert least[i] == 0
        assert named == wanted


def test_merged_spans():
    a, b = c.merged_spans(np.array([5, 0, 2, 9]), np.array([7, 2, 3, 9]))
    assert a.tolist() == [0, 5, 9] and b.tolist() == [3, 7, 9]
