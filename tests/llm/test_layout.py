"""Sharding and the Merkle manifest against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweft.llm import merkle, queries, ranks, sharding


# ------------------------------------------------------------------ sharding
def scores(key, weights):
    def score(shard, w):
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        return -math.log(u) / w
    return [(score(s, w), s) for s, w in enumerate(weights) if w]


def shard_model(doc_id, weights):
    return min(scores("-" if doc_id is None else f"={doc_id}", weights))[1]


def check_slots(got):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards(spark, docs, rows, odd_docs, no_docs):
    weights = [1.0, 2.5, 0.0, 0.5, 1.0]
    got = sharding.shard_documents(docs, weights).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", shard_model(i, weights),
                shard_model(i, [*weights, 1.0])) for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == want
    check_slots(got)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == \
        [i for _, i in sorted((x[3], i) for i, x in want.items())]
    odd = sharding.shard_documents(odd_docs, [1.0] * 3).collect()
    check_slots(odd)
    assert len(odd) == 8 and len({r.shard for r in odd if r.doc_id is None}) == 1 and len({r.shard for r in odd if r.doc_id == 1}) == 1
    assert sharding.shard_documents(no_docs, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [0.0])


def test_shares_follow_weights_and_growth_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = [1.0, 2.0, 3.0, 4.0]
    share = Counter(r.s for r in ids.select(sharding.shard_of(F.col("doc_id"), weights).alias("s")).collect())
    assert all(abs(share[k] / 20_000 - w / 10) < 0.015 for k, w in enumerate(weights))
    grown = sharding.moved(ids, weights, [*weights, 2.0]).collect()
    assert {r.new_shard for r in grown} == {4} and abs(len(grown) / 20_000 - 2 / 12) < 0.015
    gone = sharding.moved(ids, weights, [1.0, 0.0, 3.0, 4.0]).collect()
    assert {r.old_shard for r in gone} == {1} and len(gone) == share[1]
    heavier = sharding.moved(ids, weights, [1.0, 2.0, 5.0, 4.0]).collect()
    assert {r.new_shard for r in heavier} == {2}


def test_written_shards_hold_all_rows(spark, docs, tmpdir_path):
    sharding.write_shards(docs, [1.0] * 4, f"{tmpdir_path}/out", files_per_shard=2)
    back = spark.read.parquet(f"{tmpdir_path}/out")
    assert sorted((r.doc_id, r.text, r.shard) for r in back.collect() if r.text) == \
        sorted((r.doc_id, r.text, shard_model(r.doc_id, [1.0] * 4)) for r in docs.collect() if r.text)
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


def test_gapless_ranks_with_a_hot_group_and_repeated_rows(spark):
    rows = spark.createDataFrame([("h", k // 50) for k in range(500)] + [(None, 1), (None, None), ("a", 3)], "g string, v int").repartition(7)
    got = defaultdict(list)
    for r in ranks.gapless(rows, ["g"], ["v"], "at", partitions=6).collect():
        got[r.g].append((r.at, -1 if r.v is None else r.v))
    for places in got.values():
        places.sort()
        assert [x for x, _ in places] == list(range(len(places))) and [v for _, v in places] == sorted(v for _, v in places)


# ------------------------------------------------------------------ Merkle
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return digest(*[field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree_model(leaves, fan_out):
    """(top digest, proof of each leaf as [(before, after), ...])"""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // fan_out * fan_out
            proofs[i].append(("".join(level[first:place]), "".join(level[place + 1:first + fan_out])))
        level = [digest(*level[k:k + fan_out]) for k in range(0, len(level), fan_out)]
        at = [place // fan_out for place in at]
    return level[0], proofs


def manifest_model(rows, changed, fan_out=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, changed(r)), r.doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree_model([x[2] for x in sorted(groups[s], key=lambda x: x[:4])], fan_out) for s in names}
    root, over = tree_model([tops[s][0] for s in names], fan_out)
    out = []
    for k, s in enumerate(names):
        for x, proof in zip(sorted(groups[s], key=lambda x: x[:4]), tops[s][1]):
            proof, now = proof + over[k], x[3]
            for before, after in proof:
                now = digest(before, now, after)
            out.append((x[4], x[2], tops[s][0], root, digest(*[a + b for a, b in proof]), now, now == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(df):
    return sorted((tuple(r[x] for x in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan_out", [16, 2])
def test_manifest(spark, docs, odd_docs, no_docs, fan_out):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    change = {"text": merkle.lowered(F.col("text"))}
    want = manifest_model(docs.collect(), lambda r: r.text and r.text.translate(lower), fan_out)
    assert found(merkle.verify_documents(docs, change, fan_out)) == want
    assert 0 < sum(not x[-1] for x in want) < len(want)
    same = merkle.verify_documents(docs, fan_out=fan_out)
    assert all(x[-1] for x in found(same)) and found(same) == manifest_model(docs.collect(), lambda r: r.text, fan_out)
    assert found(merkle.verify_documents(odd_docs, change, fan_out)) == \
        manifest_model(odd_docs.collect(), lambda r: r.text and r.text.translate(lower), fan_out)
    assert found(merkle.verify_documents(no_docs, fan_out=fan_out)) == []


def test_sizes_around_full_runs(spark):
    for n in (1, 2, 16, 17, 33, 257):
        docs = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "CAST(NULL AS STRING) AS lang", "1L AS n_chars",
                                         "concat('T', id) AS text")
        assert found(merkle.verify_documents(docs)) == manifest_model(docs.collect(), lambda r: r.text)


def test_nodes_carry_intervals(spark, docs):
    _, levels, sources = merkle.manifest(docs, fan_out=3)
    total = sum(r.hi - r.lo for r in levels[0].collect())
    assert total == docs.count() and sources.count() == docs.select("source").distinct().count()
    for below, up in zip(levels, levels[1:]):
        inner = {(r.tree, x.lo, x.hi, x.digest) for r in up.collect() for x in r.children}
        assert inner <= {(r.tree, r.lo, r.hi, r.digest) for r in below.collect()}
        assert all(r.lo == r.children[0].lo and r.hi == r.children[-1].hi and len(r.children) <= 3 for r in up.collect())


def test_queries_run(spark):
    for name in ("op11_rendezvous_shards", "op12_merkle_manifest"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
