"""A Merkle manifest of a table by nested intervals.

Each source's documents, by ascending id, are the leaves 0, 1, 2, ... of a tree; 16 consecutive nodes become the hash of
their digests until one node remains. A node is labelled (source, level, lo, hi): the half-open interval of leaf ranks
it covers. Ancestry is containment of intervals: node and ancestor are joined within the bucket that the level gives
(lo divided by the level's width), and a node's siblings are what its parent's interval leaves when the node's own is
taken out. The sources' top digests are the leaves of one more tree of the same kind.

Levels are built upwards, each from groups of at most 16 rows; proofs go downwards, so that only inner nodes carry
partial proofs and each leaf meets its whole proof in one join. No source, however large, is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm import common as c
from logweft.llm.ranks import gapless

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: what the parent hashes before and after the node.
PROOF = "array<struct<before:string,after:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields end to end: ``-`` for a null, else UTF-8 byte count, ``:``, value."""
    value = lambda x: F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))
    return F.sha2(F.concat(*[F.coalesce(value(x), F.lit("-")) for x in fields]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tree(source: Column) -> Column:
    """Name of a source's tree; a null source has one of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _upwards(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """Levels of all trees from the leaves (``tree, level, lo, hi, digest``) up, as written tables; inner nodes also hold
    their ``children`` in order. A tree ends with the level at which it has one node."""
    levels = [leaves]
    while True:
        height = len(levels)
        family = levels[-1].withColumn("bucket", F.expr(f"lo div {fan_out ** height}")).groupBy("tree", "bucket").agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        # a first node without a sibling is all that its tree has
        family = family.filter("bucket > 0 OR size(children) > 1")
        up = family.select("tree", F.lit(height).alias("level"), F.col("children")[0]["lo"].alias("lo"),
                           F.element_at("children", -1)["hi"].alias("hi"),
                           F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children")
        up = c.written(up, f"nodes-{height}")
        if not up.limit(1).count():
            c.removed(up)
            return levels
        levels.append(up)


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The node of each tree that remains: ``tree, level, lo, digest``."""
    nodes = [x.select("tree", "level", "lo", "digest") for x in levels]
    out = nodes[0]
    for up in nodes[1:]:
        out = out.unionByName(up)
    return out.groupBy("tree").agg(F.max_by(F.struct("level", "lo", "digest"), "level").alias("top")).select("tree", "top.*")


def _step(lo: Column, hi: Column) -> Column:
    """One level of a proof: the children in the parent's interval less the node's own, before it and after it."""
    digests = lambda keep: F.array_join(F.transform(F.filter("children", keep), lambda x: x["digest"]), "")
    return F.struct(digests(lambda x: (x["lo"] >= F.col("p_lo")) & (x["hi"] <= lo)).alias("before"),
                    digests(lambda x: (x["lo"] >= hi) & (x["hi"] <= F.col("p_hi"))).alias("after"))


def _downwards(levels: list[DataFrame], tops: DataFrame, fan_out: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``tree, lo``, the ``carried`` columns of the leaves and all columns of their tree's row of ``tops`` (``tree, level,
    lo, proof`` and more), the proof extended down to the leaf."""
    held, payload = None, [x for x in tops.columns if x not in ("tree", "level", "lo", "proof")]
    for height in range(len(levels) - 1, -1, -1):
        own = list(carried) if height == 0 else []
        nodes = levels[height].select("tree", "lo", "hi", *own)
        ended = nodes.select("tree", "lo", *own).join(
            tops.filter(F.col("level") == height).select("tree", "lo", *payload, "proof"), ["tree", "lo"])
        if held is None:
            held = ended
        else:
            bucket = F.expr(f"lo div {fan_out ** (height + 1)}")
            parents = levels[height + 1].select("tree", "lo", "hi", "children").join(held, ["tree", "lo"]).select(
                "tree", bucket.alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "children", *payload, "proof")
            inside = (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))
            found = nodes.withColumn("bucket", bucket).join(parents, ["tree", "bucket"]).filter(inside).select(
                "tree", "lo", *own, *payload, F.concat(F.array(_step(F.col("lo"), F.col("hi"))), "proof").alias("proof"))
            held = found.unionByName(ended)
        if height:                       # the leaves' proofs go straight to their reader
            held = c.written(held, f"proofs-{height}")
    return held


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and a proof give."""
    return F.aggregate(proof, digest, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all sibling digests, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def manifest(docs: DataFrame, fan_out: int = FAN_OUT, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None
             ) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(leaves, levels, sources) of a table.

    ``leaves``: ``tree, lo, doc_id, leaf, now, subroot, root, proof``, one row per input row; ``levels``: tables of nodes
    (``tree, level, lo, hi, digest``, inner ones with ``children``) from the leaves up; ``sources``: ``tree, lo, level,
    subroot, root, proof`` of the trees. ``now`` is the leaf's digest with the columns of ``changed`` in place of the
    stored ones (the same without).

    Rows are ordered by source (null first, then by bytes) and id (null first); rows that share both by their digest, and
    equal rows are leaves of their own. Columns other than ``fields`` are ignored. An empty table has no leaves.
    """
    c.prepare(docs.sparkSession)
    now = {x: (changed or {}).get(x, F.col(x)) for x in fields}
    rows = docs.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf_digest(*[F.col(x) for x in fields]).alias("leaf"), leaf_digest(*now.values()).alias("now"))
    rows = c.written(gapless(c.written(rows, "leaves"), ["tree"], ["doc_id", "leaf", "now"], "lo"), "ranked-leaves")
    levels = _upwards(_leaves(rows, "tree", "leaf", "doc_id", "leaf", "now"), fan_out)
    # the tree over the sources; the name of a null source sorts before all others
    tops = c.written(_tops(levels).withColumn("all", F.lit("*")), "tops")
    ranked = c.written(gapless(tops.withColumnRenamed("lo", "own_lo"), ["all"], ["tree"], "lo"), "ranked-tops")
    over = _upwards(_leaves(ranked, "all", "digest", F.col("tree").alias("name"), F.col("level").alias("height"),
                            F.col("digest").alias("subroot")), fan_out)
    root = _tops(over).select("tree", "level", "lo", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    sources = c.written(_downwards(over, root, fan_out, ("name", "height", "subroot")).select(
        F.col("name").alias("tree"), "lo", F.col("height").alias("level"), "subroot", "root", "proof"), "sources")
    leaves = _downwards(levels, sources.select("tree", "level", F.lit(0).cast("long").alias("lo"), "subroot", "root", "proof"),
                        fan_out, ("doc_id", "leaf", "now"))
    return leaves, levels, sources


def _leaves(rows: DataFrame, tree: str, digest: str, *more) -> DataFrame:
    return rows.select(F.col(tree).alias("tree"), F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"),
                       F.col(digest).alias("digest"), *more)


def verify_documents(docs: DataFrame, changed: dict[str, Column] | None = None, fan_out: int = FAN_OUT,
                     fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per input row.

    The manifest is that of ``docs``; ``folded_root`` folds the row's digest with ``changed`` columns through its stored
    proof, and ``verified`` says whether it is the root. For odd rows see :func:`manifest`.
    """
    leaves, _, _ = manifest(docs, fan_out, fields, changed)
    out = leaves.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                        folded(F.col("now"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
