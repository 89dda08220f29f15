import hashlib
import random
import re

import numpy as np

from logweft.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_model(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for j in range(len(words) - k + 1):
            w = tuple(words[j:j + k])
            if w in seen:
                gone[j:j + k] = [True] * k
            seen.add(w)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def suffix_model(rows, n):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first.setdefault(b[j:j + n], i) < i:
                gone[j:j + n] = b"\1" * n
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


def jaccard_model(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    component = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    return {i: (len(s), component[i]) for i, s in sets.items()}


def test_substrings(docs, rows):
    for k, gram in ((20, 5), (6, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept)
               for r in substring_dedup.dedup_substrings(docs, k=k, gram=gram).collect()}
        assert got == substring_model(rows, k)


def test_suffixes(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 20)      # many buckets, so that runs cross boundaries
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got == suffix_model(rows, 50)


def test_multikey_order():
    import numpy as np
    rows = np.random.default_rng(3).integers(0, 2, (500, 21)).astype(np.uint8)
    got = [bytes(r) for r in rows[suffix_dedup.multikey_order(rows)]]
    assert got == sorted(map(bytes, rows))


def test_jaccard(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == jaccard_model(rows)


def test_jaccard_chains_and_small_sets(spark):
    """Chains of links, sets of a few shingles, pairs just at and below the threshold; groups larger than a block."""
    import random
    rng = random.Random(11)
    texts = []
    for size in (1, 2, 4, 5, 8, 9, 12, 20, 33, 70, 200):
        base = [f"t{rng.randint(0, 10**6)}" for _ in range(size + 4)]
        for step in range(8):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, size // 45)):
                base[rng.randrange(len(base))] = f"u{rng.randint(0, 10**6)}"
            if step % 3 == 2:
                base.append(f"v{step}")
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == jaccard_model(rows)


def test_pigeonhole_keys_and_blocks():
    """A linked pair shares more keys than a probing set may leave out; sketches never rule a linked pair out."""
    import numpy as np
    rng = np.random.default_rng(2)
    for size in (1, 3, 6, 9, 16, 31, 33, 64, 90, 128, 300):
        for _ in range(12):
            a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            cut = int(rng.integers(0, size // 9 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(1, 1 << 62, int(rng.integers(0, size // 9 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            key, doc, role = jaccard_join.keys_of(np.array([1, 2]), np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            at = {1: {}, 2: {}}
            for k, d, r in zip(key.tolist(), doc.tolist(), role.tolist()):
                at[d][k] = at[d].get(k, 0) | r
            shared = at[1].keys() & at[2].keys()
            first, second = (1, 2) if len(a) >= len(b) else (2, 1)       # the larger one probes
            big, small = max(len(a), len(b)), min(len(a), len(b))
            low = (1 << small.bit_length()) - 1
            if big < jaccard_join.SMALL or low < jaccard_join.SMALL and big.bit_length() > small.bit_length():
                assert any(at[x][k] & 2 and at[y][k] & 1 for k in shared for x, y in ((1, 2), (2, 1)))
            else:
                same = big.bit_length() == small.bit_length()
                bit, bound = (4, 2 * big // 9) if same else (8, (big + low) // 9)
                hits = [k for k in shared if at[first][k] & bit and at[second][k] & 1]
                assert len(hits) > jaccard_join._segments_of(low) - (bound + 1)
            sketches = []
            for own in (a, b):
                bits = jaccard_join._sketch_bits(len(own))
                odd = np.bincount((jaccard_join.c.mixed(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                sketches.append(np.packbits(odd.astype(bool)).tobytes())
            low = jaccard_join.differing(*sketches)
            assert low <= len(a) + len(b) - 2 * both and jaccard_join.may_link(len(a), len(b), low)


def test_blocks_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    common = [f"c{k}" for k in range(40)]
    rows = [(i, " ".join([*common, *(f"d{i}x{j}" for j in range(60 + i % 7))])) for i in range(30)]
    rows += [(100 + i, t + " tail") for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == jaccard_model(rows)


def test_exact_batches(spark, docs, rows):
    index = exact_dedup.create_index(spark, buckets=4)
    got = exact_dedup.dedup_exact(docs, index, buckets=4).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {
        i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    # a later batch: known texts go, of new ones the largest id stays, and the index grows by those
    later = spark.createDataFrame([(9001, rows[0][1]), (9002, "new"), (9003, "new")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_exact(later, index, buckets=4).collect()}
    assert got == {9001: (max(groups[rows[0][1]]), False), 9002: (9003, False), 9003: (9003, True)}
    assert spark.table(index).count() == len(groups) + 1
    plan = later.select(exact_dedup.text_digest(later.text).alias("digest")).join(
        spark.table(index).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 or "Bucketed: true" in plan


def test_exact_in_id_ranges(spark, docs, odd_docs, no_docs, monkeypatch):
    tables = lambda: sorted(t.name for t in spark.catalog.listTables())
    before, met = tables(), []
    append = exact_dedup.append_new

    def watched(groups, index, buckets):
        known = spark.table(index).select("digest")
        met.append((known.count(), groups.join(known, "digest").count()))
        return append(groups, index, buckets)
    monkeypatch.setattr(exact_dedup, "append_new", watched)
    for some in (docs, odd_docs, no_docs):
        want = sorted(map(str, exact_dedup.dedup_exact(some, buckets=4).collect()))
        keep = sorted(map(str, exact_dedup.keep_new(some, buckets=4).select("doc_id", "text").collect()))
        for n in (2, 3):
            met.clear()
            assert sorted(map(str, exact_dedup.dedup_exact(some, buckets=4, batches=n).collect())) == want
            if some is not no_docs:
                assert len(met) > 1 and met[-1][0] > 0 and max(x for _, x in met) > 0      # later batches met known texts
            got = exact_dedup.keep_new(some, buckets=4, batches=n).select("doc_id", "text").collect()
            assert sorted(map(str, got)) == keep
    assert tables() == before


def test_odd_rows(spark, odd_docs, no_docs):
    text = " ".join(f"w{k}" for k in range(30))
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(odd_docs).collect())
    assert got == [(1, 0), (2, 30), (3, 0), (4, 0)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_suffixes(odd_docs).collect())
    assert got == [(1, 0), (2, len(text)), (3, 0), (4, 0)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(odd_docs).collect())
    assert got == [(1, 26, 1), (2, 26, 1), (3, 1, 3), (4, 0, 4)]
    got = exact_dedup.dedup_exact(odd_docs).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 3
    assert sorted((r.group_size, r.kept) for r in got if r.keep_id == 2) == [(4, False)] * 3 + [(4, True)]
    kept = exact_dedup.keep_new(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    for made in (substring_dedup.dedup_substrings(no_docs), suffix_dedup.dedup_suffixes(no_docs),
                 jaccard_join.near_duplicates(no_docs), exact_dedup.dedup_exact(no_docs), exact_dedup.keep_new(no_docs)):
        assert made.count() == 0


def test_large_group_of_near_copies_settles_in_rounds(spark, monkeypatch):
    """2,000 changed copies of one text, many of them not linked to the same hub, some linked to nothing."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(70)]
    texts = []
    for _ in range(2000):
        words = list(base)
        for at in rng.sample(range(70), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(words)
    sets = [{tuple(w[j:j + 5]) for j in range(66)} for w in texts]
    names = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((2000, len(names)), np.float32)
    for k, s in enumerate(sets):
        held[k, [names[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    component = np.arange(2000)
    while True:
        least = np.where(linked, component[None, :], 2000).min(1)
        if (least == component).all():
            break
        component = least
    assert linked.sum(1).max() < 1900 and 1 < len(set(component.tolist())) < 1900
    rows_of = {}
    blocks = jaccard_join.block_pairs
    monkeypatch.setattr(jaccard_join, "block_pairs", lambda rows, sets: rows_of.setdefault("pairs", jaccard_join.c.written(blocks(rows, sets), "seen")))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(component.tolist()))
    assert "pairs" not in rows_of or rows_of["pairs"].count() < 20_000           # of two million
