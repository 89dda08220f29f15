"""Cross-tokenizer alignment against plain Python over the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from logweft.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "  two  blanks ", "a▁b", "<|endoftext|> and </s> <unk> <0x0A>", "\U0001f600 smile", "العربية हिन्दी",
       "x" * 3000, "Ａ ﬁ é é", "a\u0000b", "it's 'll don't", "漢字 かな"]


def model(rows):
    tok, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet = {ch: b for b, ch in enumerate(token_alignment.bs.byte_alphabet())}

    def piece_bytes(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    found, corpus = [], Counter()
    for i, text in rows:
        want = (" " + (text or "")).encode()
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        parts = [bytes(alphabet[ch] for ch in tok.id_to_token(x)) for x in a], [piece_bytes(x) for x in b]
        if not text or any(b"".join(p) != want for p in parts):
            found.append((i, [], [], "", []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, links, lo = [], [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            hi = tuple(sum(x <= end for x in e) for e in ends)
            groups.append(",".join(map(str, a[lo[0]:hi[0]])) + "|" + ",".join(map(str, b[lo[1]:hi[1]])))
            lo = hi
        links = [(a[j], b[k]) for j, x in enumerate(ends[0]) for k, y in enumerate(ends[1]) if x == y]
        corpus.update(links)
        found.append((i, a, b, ";".join(groups), links))
    top = {}
    for (_, y), n in corpus.items():
        top[y] = max(n, top.get(y, 0))
    return {i: (len(a), len(b), g.count(";") + bool(g), len(links), sum(corpus[x] == top[x[1]] for x in links),
                sum(corpus[x] for x in links), g) for i, a, b, g, links in found}


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment(spark, rows):
    rows = [(i, t) for i, t in rows if len(t or "") < 6000] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = model(rows)
    assert sum(x[0] == 0 for x in want.values()) > 3 and any(x[3] != x[4] for x in want.values())
    for size in (token_alignment.BLOCK_LINKS, 100):
        got = {r.doc_id: tuple(r[x] for x in NAMES) for r in token_alignment.align_documents(docs, A, B, block_links=size).collect()}
        assert got == want
    digests = {r.doc_id: r.groups for r in token_alignment.align_documents(docs, A, B, digests=True).collect()}
    assert digests == {i: hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for i, x in want.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    got = token_alignment.align_documents(odd_docs, A, B).collect()
    assert len(got) == 8 and sum(r.doc_id is None for r in got) == 2 and sum(r.n_a == 0 for r in got) == 3
    same = [r for r in got if r.doc_id in (1, 2)]
    assert len({tuple(r)[1:] for r in same}) == 1 and same[0].count_sum > same[0].n_links
    assert token_alignment.align_documents(no_docs, A, B).count() == 0


def test_ids_without_bytes_are_linked_with_all_that_end_there():
    ends_a, ends_b = np.array([2, 2, 5]), np.array([2, 4, 5, 5])
    cuts, last_a, last_b = token_alignment.common_ends(ends_a, ends_b)
    assert cuts.tolist() == [2, 5] and last_a.tolist() == [1, 2] and last_b.tolist() == [0, 3]
    x, y = token_alignment.slice_links(ends_a, ends_b, cuts)
    assert sorted(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (2, 2), (2, 3)]


def test_units_encode_like_whole_texts(spark, rows):
    """Word-by-word encoding is the model's own, also for blanks in odd places."""
    rng = random.Random(9)
    texts = ["".join(rng.choice([" ", "  ", "a", "the", "\n", "é", "1", "▁", "漢", "\t"]) for _ in range(rng.randint(1, 12)))
             for _ in range(3000)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    import pyarrow as pa
    from logweft.llm import common as c
    made = next(c.text_steps(pa.array([" " + t for t in texts]), 1 << 30))[1]
    ids, bounds = token_alignment.b_ids(made, B)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == pieces.encode(texts)


def test_query(spark):
    got = queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = model([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {
        i: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for i, x in want.items()}
