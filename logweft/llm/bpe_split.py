"""Splitting texts into BPE words in generated code, and a tokenizer's parts that a task needs."""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column, functions as F
from tokenizers import Tokenizer

#: Characters that Java's and the tokenizers library's tables read alike, and that NFC leaves alone: Latin, Cyrillic,
#: common punctuation, kana, common ideographs, Hangul syllables. (Tests compare them one by one.) Texts with others
#: are split by the library itself.
PLAIN = r"[^\x00-ɏЀ-҂Ҋ-ӿ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]"

_SPACE = r"\p{IsWhite_Space}"
# The split patterns of the two vocabularies, in Java's spelling.
BYTE_SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{_SPACE}\p{{L}}\p{{N}}]+"
              rf"|{_SPACE}+(?!\P{{IsWhite_Space}})|{_SPACE}+")
WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


def is_plain(text: Column, specials: list[str]) -> Column:
    plain = ~text.rlike(PLAIN)
    for special in specials:
        plain = plain & ~F.contains(text, F.lit(special))
    return plain


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file with truncation and padding off; loaded once per Python worker."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    out, extra = [], 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return tuple(out)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    return {ch: b for b, ch in enumerate(byte_alphabet())}


def to_byte_level(word: str) -> str:
    table = byte_alphabet()
    return "".join([table[b] for b in word.encode()])


def library_words(path: str, text: str) -> list[str]:
    """The words of a text as the library splits them, special tokens as themselves."""
    tok, specials, back = tokenizer(path), special_tokens(path), _byte_of()
    parts = regex.split("(" + "|".join(regex.escape(s) for s in specials) + ")", text) if specials else [text]
    out: list[str] = []
    for part in parts:
        if part in specials:
            out.append(part)
        elif part:
            if tok.normalizer is not None:
                part = tok.normalizer.normalize_str(part)
            out += [bytes(back[ch] for ch in w).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(part)]
    return out
