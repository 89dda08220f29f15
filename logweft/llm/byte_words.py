"""Words of a byte-level BPE as array operations, and a table of the ids of words met before.

The split pattern (``bpe_split.BYTE_SPLIT``) is regular in the classes of a few neighbouring characters, so all word
starts of a step of documents come from comparisons of class arrays. Texts with characters outside ``PLAIN_RANGES``
(whose class the library might read from other Unicode tables) are named as odd and left to the library.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Callable, Iterable

import numpy as np

from logweft.llm import bpe_split as bs
from logweft.llm import common as c

#: First and last code points of blocks whose letters, numbers and white space all Unicode tables in use agree on.
PLAIN_RANGES = ((0x0, 0x24F), (0x400, 0x482), (0x48A, 0x4FF), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA),
                (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_ODD, _LETTER, _NUMBER, _OTHER, _SPACE, _BLANK = range(6)
_SPACES = {*range(0x09, 0x0E), 0x85, 0xA0}
#: Second letters of the contractions by their first; None: one letter.
_CONTRACTIONS = {"s": None, "t": None, "m": None, "d": None, "r": "e", "v": "e", "l": "l"}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for first, last in PLAIN_RANGES:
        for x in range(first, last + 1):
            kind = unicodedata.category(chr(x))[0]
            table[x] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[list(_SPACES)] = _SPACE
    table[0x20] = _BLANK
    return table


def _characters(data: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Byte place of each character (None: each byte is one) and its code point."""
    if not len(data) or data.max() < 0x80:
        return None, data
    at = np.flatnonzero(data & 0xC0 != 0x80)
    point = data[at].astype(np.int32)
    more = np.flatnonzero(point >= 0xC0)             # leads of characters of two bytes or more
    lead = point[more]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & (0xFF >> (size + 1))
    for k in range(1, 4):
        on = np.flatnonzero(size > k)
        value[on] = value[on] << 6 | data[at[more[on]] + k] & 0x3F
    point[more] = value
    return at, point


def word_starts(texts: c.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where words begin (each ends where the next one begins), and which documents are odd.

    The words of odd documents are not to be used.
    """
    data, n_docs = texts.data, len(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_docs, bool)
    at, point = _characters(data)
    kind = _classes()[point]
    n = len(kind)
    filled = np.unique(texts.offsets[:-1][np.diff(texts.offsets) > 0])
    heads = filled if at is None else np.searchsorted(at, filled)
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True

    group = np.minimum(kind, _SPACE)                 # white space is one group
    white = group == _SPACE
    start = head.copy()                              # a run of one group begins
    start[1:n] |= group[1:] != group[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (kind[:-1] == _BLANK) & ~head[1:n]
    begin = head[:n] | (start[:n] & (white | ~blank_before))
    # the last white character before something else goes by itself, or with it if it is a blank
    begin[:-1] |= white[:-1] & ~white[1:] & ~head[1:n]
    # contractions: an apostrophe that begins a word and has letters after it
    mark = np.flatnonzero((point == 0x27) & begin)
    mark = mark[mark + 1 < n]
    mark = mark[~head[mark + 1] & (kind[mark + 1] == _LETTER)]
    if len(mark):
        first = point[mark + 1]
        second = np.where((mark + 2 < n) & ~head[np.minimum(mark + 2, n)], point[np.minimum(mark + 2, n - 1)], 0)
        length = np.zeros(len(mark), np.int64)
        for a, b in _CONTRACTIONS.items():
            length[(first == ord(a)) & (second == ord(b) if b else True)] = 2 if b else 1
        mark, length = mark[length > 0], length[length > 0]
        begin[mark + 1] = False
        rest = mark + 1 + length
        begin[rest[rest < n]] = True
    found = np.flatnonzero(begin)
    odd_at = np.flatnonzero(kind == _ODD)
    if at is not None:
        found, odd_at = at[found], at[odd_at]
    odd = np.zeros(n_docs, bool)
    odd[np.searchsorted(texts.offsets, odd_at, side="right") - 1] = True
    return found, odd


class IdTable:
    """Ids of words, each encoded once and remembered under the 64-bit hash of its bytes.

    ``encode`` turns a list of words into a list of id lists. Beyond ``limit`` words the table keeps those that were
    met again since they were learned, or starts anew if these are over half of it, so its memory is bounded (about 40
    bytes a word and 4 an id).
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)                # by slot: met after the step that learned it

    def _keep_used(self) -> None:
        kept = np.flatnonzero(self.again[self.slots])
        keys, slots = self.keys[kept], self.slots[kept]
        if not len(kept) or len(kept) > self.limit // 2:
            return self._forget()
        sizes = self.starts[slots + 1] - self.starts[slots]
        self.ids = self.ids[c.ranges(self.starts[slots], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.keys, self.slots, self.again = keys, np.arange(len(keys)), np.zeros(len(keys), bool)

    def ids_of(self, texts: c.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at the given places, end to end, and how many each word has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, first, place = np.unique(c.byte_hashes(texts).spans(starts, ends), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        self.again[self.slots[at[known]]] = True
        if not known.all() and len(self.keys) + len(keys) - int(known.sum()) > self.limit:
            self._keep_used()
            at, known = self._find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(keys[new], [texts.data[starts[i]:ends[i]].tobytes().decode() for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][place]
        sizes = self.starts[slot + 1] - self.starts[slot]
        return self.ids[c.ranges(self.starts[slot], sizes)], sizes

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the table's keys hold these, and which it has."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        coded = list(self.encode(words))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((x for ids in coded for x in ids), np.uint32, int(sizes.sum()))
        slots = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        self.again = np.concatenate([self.again, np.zeros(len(keys), bool)])
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]


@lru_cache(maxsize=4)
def byte_table(path: str) -> IdTable:
    """The table of a byte-level vocabulary, shared by the tasks of a Python worker."""
    model = bs.tokenizer(path).model

    def encode(words: list[str]) -> Iterable[list[int]]:
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words]).tolist()
        text = bs.to_byte_level("".join(words))       # a character a byte
        return ([t.id for t in model.tokenize(text[a:b])] for a, b in zip([0, *ends], ends))
    return IdTable(encode)


def coded_documents(texts: c.Texts, starts: np.ndarray, table: IdTable, odd: np.ndarray, whole: Callable[[str], list[int]]
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, end to end, and the bounds of each document (length len(texts) + 1): the words that begin at
    ``starts`` by the table, odd documents by ``whole``."""
    ends = np.append(starts[1:], len(texts.data)) if len(starts) else starts
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    if odd.any():
        keep = ~odd[owner]
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
    ids, sizes = table.ids_of(texts, starts, ends)
    counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    if not odd.any():
        return ids, cuts
    parts = [np.asarray(whole(texts.bytes_of(i).decode()), np.uint32) if odd[i] else ids[cuts[i]:cuts[i + 1]]
             for i in range(len(texts))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def encode_texts(texts: c.Texts, path: str, whole: Callable[[str], list[int]], refused: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """:func:`coded_documents` of a byte-level vocabulary; documents of the mask ``refused`` are odd, too."""
    starts, odd = word_starts(texts)
    return coded_documents(texts, starts, byte_table(path), odd if refused is None else odd | refused, whole)
