"""Quality rules with suffix-array repetition.

Per document: word and symbol counts, repeated lines, repeated three-word windows (the base rules), and the maximal
repeated substrings of its word sequence. The suffix array of every document in a step is built at once by prefix
doubling: suffixes start ranked by (document, word), so that no match leaves its document, and only suffixes that are
still tied are sorted again. The ranks of each round give the longest common prefix of neighbouring suffixes by binary
descent; a suffix's deepest LCP interval is the larger of the two at its sides, and those that a repeat one word to the
left does not already hold are the maximal repeats. Their spans are united per document.

A map-only job: one Arrow batch at a time, a step of about one megabyte of text (or one document) in memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from logweft.llm import common as c


@dataclass(frozen=True)
class Limits:
    """Base rules (fixed values of the contract) and the limits of the repetition rule."""
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A repeat counts from this many words.
    repeat_words: int = 10
    #: Rejected above this percentage of words in repeats ...
    max_covered_percent: int = 30
    #: ... or if one repeat is longer than this many words and than this percentage of the document's words (0: of any).
    max_longest: int = 100
    max_longest_percent: int = 10


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_repeats(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring starting there that also starts elsewhere in its document.

    ``symbols``: integers or hashes; ``doc``: the document of each position, ascending.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    _, word = np.unique(symbols, return_inverse=True)
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank, tied = _ranks(key[order], order, n)
    levels = [rank]
    width = 1
    while tied.any():
        # tied suffixes: order by the rank of what follows their first `width` words (nothing, in the same document: -1)
        spots = np.flatnonzero(tied)
        part = order[spots]
        ahead = part + width
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[part[inside]]
        follow = np.full(len(part), -1, np.int64)
        follow[inside] = rank[ahead[inside]]
        by = np.lexsort((follow, rank[part]))
        part, follow = part[by], follow[by]
        order[spots] = part
        new = np.ones(len(part), bool)
        new[1:] = (rank[part[1:]] != rank[part[:-1]]) | (follow[1:] != follow[:-1]) | (follow[1:] < 0)
        rank = rank.copy()
        rank[part] = spots[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
        same = ~new
        still = same.copy()
        still[:-1] |= same[1:]
        tied = np.zeros(n, bool)
        tied[spots[still]] = True
        levels.append(rank)
        width *= 2
    # common prefix of neighbours in suffix order: take the longest doubled step whose ranks agree, and go on behind it
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(doc[a] == doc[b])
    for k in range(len(levels) - 1, -1, -1):
        at_a, at_b = a[live], b[live]
        fits = (at_a < n) & (at_b < n)
        fits[fits] = (doc[at_a[fits]] == doc[order[:-1][live[fits]]]) & (doc[at_b[fits]] == doc[order[1:][live[fits]]])
        fits[fits] = levels[k][at_a[fits]] == levels[k][at_b[fits]]
        step = live[fits]
        common[step] += 1 << k
        a[step] += 1 << k
        b[step] += 1 << k
    deepest = np.zeros(n, np.int64)
    deepest[order[:-1]] = common
    deepest[order[1:]] = np.maximum(deepest[order[1:]], common)
    return deepest


def _ranks(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    return rank, tied


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


def _repeat_lines(texts: c.Texts, starts: np.ndarray) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(texts.data == 10)
    first = np.unique(np.concatenate([texts.offsets[:-1], breaks + 1]))
    first = first[first < len(texts.data)]
    if not len(first):
        return np.zeros(len(texts), np.int64)
    stop = np.concatenate([first[1:], [len(texts.data)]])
    closed = texts.data[stop - 1] == 10
    hashes = c.byte_hashes(texts).spans(first, stop - closed)
    owner = np.searchsorted(texts.offsets, first, side="right") - 1
    wordy = np.searchsorted(starts, first) < np.searchsorted(starts, stop)
    hashes, owner = hashes[wordy], owner[wordy]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[again], minlength=len(texts))


def measure_texts(texts: c.Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All measures and verdicts of a step's documents."""
    starts, ends, bounds = c.word_spans(texts)
    words = c.word_hashes(texts, starts, ends)
    n = len(words)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = ~c._SPACE[texts.data]
    out = {"n_words": counts,
           "word_chars": _per_doc(inside & ((texts.data & 0xC0) != 0x80), texts.offsets),
           "n_symbols": _per_doc(_SYMBOL[texts.data], texts.offsets),
           "n_dup_lines": _repeat_lines(texts, starts)}
    deepest = suffix_repeats(words, doc)
    three = np.flatnonzero(deepest >= 3)
    out["n_repeat_words"] = _per_doc(_covered(three, np.full(len(three), 3), n), bounds)
    # maximal repeats: long enough, and not the tail of the repeat that starts one word earlier
    extends = np.zeros(n, bool)
    extends[1:] = (deepest[:-1] == deepest[1:] + 1) & (doc[1:] == doc[:-1])
    maximal = np.flatnonzero((deepest >= limits.repeat_words) & ~extends)
    out["n_covered_words"] = _per_doc(_covered(maximal, deepest[maximal], n), bounds)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[maximal], deepest[maximal])
    out["longest_repeat"] = longest
    out["base_failed"] = ((counts < limits.min_words)
                          | (100 * out["n_repeat_words"] > limits.max_repeat_percent * counts))
    covered = out["n_covered_words"]
    repetitive = ((100 * covered > limits.max_covered_percent * counts)
                  | ((longest > limits.max_longest) & (100 * longest > limits.max_longest_percent * counts)))
    out["kept"] = ~out["base_failed"] & ~repetitive
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
VERDICTS = ("base_failed", "kept")


def measure(docs: DataFrame, text_col: str = "text", limits: Limits = Limits(), prefix: str = "") -> DataFrame:
    """All columns of ``docs`` plus the measures and verdicts (names prefixed with ``prefix``), row by row.

    Null and empty texts have no words: all measures 0, ``base_failed`` true, ``kept`` false. Rows are independent:
    repeated rows, null ids and other columns pass through, and an empty table gives an empty result. A column of
    ``docs`` that bears the name of a measure is replaced by it.
    """
    c.prepare(docs.sparkSession)
    extra = [prefix + name for name in (*MEASURES, *VERDICTS)]
    docs = docs.drop(*extra)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + x, T.LongType()) for x in MEASURES],
                           *[T.StructField(prefix + x, T.BooleanType()) for x in VERDICTS]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_texts(texts, limits) for _, texts in c.text_steps(batch.column(text_col))]
            cols = [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], pa.int64()) for x in MEASURES]
            cols += [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], pa.bool_()) for x in VERDICTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *extra])
    return docs.mapInArrow(of, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    return (measure(docs, text_col, limits, "__quality_").filter(F.col("__quality_kept")).select(*docs.columns))
