"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its distinct word shingles. Sets of sizes x >= y with Jaccard similarity >= 0.8 differ in at
most (x + y) / 9 shingles. Sizes fall into bands [2^b, 2^(b+1)); in a band the universe of shingles is hashed into
``m`` segments, so a set is cut into ``m`` subsets, and of any H + 1 subsets of two sets that differ in H shingles one
pair is equal. A set puts all its subsets in the index of its band and probes, in its band and in the lower one if that
can hold partners, as many as the bound asks for: the ones that cost least, by the number of sets that were counted to
share them. A subset that no other set has costs nothing, so a text of its own probes nothing at all, and passages that
many documents share are passed over.
In bands of small sets the index also holds the one-deletion neighbourhood of each subset. A probe that uses it on a
segment covers two differences there, and each small set picks the cheapest mix of skipping, exact and one-deletion
probes. Nothing is approximate: any two linked sets share a key.

Keys are counted first, pre-aggregated; only keys that two sets share come back (``shared_keys``), and of those only
the groups that are probed.
Sets that are equal are one from the start, whatever their number. In a group of sets with a key, each is compared
with the group's hub first (``star_pairs``, linear); groups that are then one component are done. Of the others, members
that the triangle inequality on their distances to the hub keeps apart need no comparison (``undecided``). Then rounds
follow (``settled``): groups that share their least member by hash become one (sets that have many subsets in common are
in as many groups), a few members of a group's components are new hubs, meet all members of other components, and leave
the group, decided; a group goes on while a round halves its components. So a group of near copies that are not all
linked to one hub settles in rounds of linear size. What is left, sets that share subsets and are no near copies, is
compared in blocks of bounded size by parity sketches (``block_pairs``): a sketch pair that differs in more bits than
the bound on H proves that the sets differ in more shingles. Every pair that passes is verified on the whole shingle
sets.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweft.llm import common as c
from logweft.llm.components import components

SHINGLE_WORDS = 5
#: Linked if PERCENT[0] * |intersection| >= PERCENT[1] * |union|; the bounds above are those of 4/5.
PERCENT = (100, 80)
#: Sets below this size also have one-deletion neighbourhoods.
SMALL = 32
#: Members of a block, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Hubs of a group in one round, and members of a group that needs no further one (a block holds it whole).
HUBS, SETTLED = 4, 64

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingle_sets(texts: c.Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, end to end; and the bounds of each document."""
    texts = c.Texts(_LOWER[texts.data], texts.offsets)
    starts, ends, bounds = c.word_spans(texts)
    rolling = c.Rolling(c.word_hashes(texts, starts, ends))
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), counts)
    grams = rolling.windows(shingle)
    whole = doc[:len(grams)] == doc[shingle - 1:] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    value = grams[whole]
    counts = np.maximum(counts - (shingle - 1), 0)
    if len(short):                                    # their one shingle goes where their words are
        value = np.insert(value, (np.cumsum(counts) - counts)[short], rolling.spans(bounds[short], bounds[short + 1]))
        counts[short] = 1
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[cuts[:-1][counts > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[cuts]


def _by_segment(segment: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stable order of each set's elements by segment, set after set."""
    out, ends = np.empty(len(segment), np.int64), np.cumsum(sizes)
    short = segment.astype(np.uint16) if len(segment) and segment.max() < 1 << 16 else segment
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        out[a:b] = short[a:b].argsort(kind="stable")
    return out + np.repeat(ends - sizes, sizes)


def _each(docs: DataFrame, schema: str, make, shingle: int, cols: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """mapInArrow over shingle sets: ``make(ids, values, bounds)`` gives the columns of the result."""
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in c.text_steps(batch.column("text")):
                values, bounds = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays(make(ids[first:first + len(texts)], values, bounds), names)
    return docs.select(*cols).mapInArrow(of, schema)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, d1, d2``: size of the set and a 128-bit commutative digest of it."""
    def make(ids, values, bounds):
        digests = []
        for salt in (0x51ED270B, 0xA0761D64):
            sums = np.concatenate([[_U(0)], np.cumsum(c.mixed(values ^ _U(salt)), dtype=np.uint64)])
            digests.append(pa.array(c.signed(sums[bounds[1:]] - sums[bounds[:-1]])))
        return [pa.array(ids), pa.array(np.diff(bounds)), *digests]
    return _each(docs, "doc_id long, n long, d1 long, d2 long", make, shingle)


# ------------------------------------------------------------------ keys
def _segments_of(high: np.ndarray) -> np.ndarray:
    """Segments of a band whose largest size is ``high``: one more than any bound on H in it (a quarter of ``high`` at
    most), and a few to spare, so that no set has to probe its empty segments, which many sets share."""
    return 9 * high // 32 + 2


class _Cut:
    """Sets cut into segments: contents, sizes and owners of all segments (empty ones too)."""

    def __init__(self, values, sizes, high):
        self.m = _segments_of(high)
        self.base = np.cumsum(self.m) - self.m
        owner = np.repeat(np.arange(len(sizes)), sizes)
        band = high[owner].astype(np.uint64)
        self.segment = ((c.mixed(values ^ c.mixed(band)) >> _U(33)).astype(np.int64)) % self.m[owner]
        self.code = self.base[owner] + self.segment
        total = int(self.m.sum())
        order = _by_segment(self.segment, sizes)
        self.element = c.mixed(values + _U(0x2545F491))
        sums = np.concatenate([[_U(0)], np.cumsum(self.element[order], dtype=np.uint64)])
        ends = np.searchsorted(self.code[order], np.arange(total + 1))
        self.content = sums[ends[1:]] - sums[ends[:-1]]
        self.size = np.diff(ends)
        self.owner = np.repeat(np.arange(len(sizes)), self.m)
        self.number = np.arange(total) - self.base[self.owner]
        self.place = c.mixed(high[self.owner].astype(np.uint64) * _U(0x9E3779B1) + self.number.astype(np.uint64))
        self.order = order

    def keys(self, content, place, deleted: bool = False):
        return c.signed(c.mixed(content + place + _U(1 if deleted else 0)))



def _mix(sizes: list[int], need: int) -> list[int]:
    """Cheapest allocation over segments of the given sizes: -1 skip, 0 exact, 1 one-deletion, with sum(e + 1) >= need.

    A subset of n shingles is taken to be shared with chance 2^-n; a one-deletion probe looks up n + 2 subsets.
    """
    best = {0: (0.0, ())}
    for n in sizes:
        after: dict[int, tuple[float, tuple]] = {}
        for have, (cost, picks) in best.items():
            for e, add in ((-1, 0.0), (0, 2.0 ** -n), (1, 2.0 ** -n + 2.0 ** -(n + 1) + (n * 2.0 ** -(n - 1) if n else 0.0))):
                total = min(need, have + e + 1)
                if total not in after or cost + add < after[total][0]:
                    after[total] = (cost + add, (*picks, e))
        best = after
    return list(best[need][1])


def _own_band(ids, values, bounds):
    sizes = np.diff(bounds)
    keep = np.flatnonzero(sizes > 0)
    ids, sizes = ids[keep], sizes[keep]                  # values of empty sets do not exist
    return ids, values, sizes, (1 << (np.frexp(sizes.astype(np.float64))[1])) - 1


#: Roles of a key row, as bits: it is in the index; it probes; it may probe in its own band; in the lower band.
INDEX, PROBE, OWN, LOWER = 1, 2, 4, 8


def keys_of(ids, values, bounds):
    """Arrays key, doc_id, role (bits, see above)."""
    ids, values, sizes, high = _own_band(ids, values, bounds)
    keys, docs, roles = [], [], []

    def add(key, doc, role):
        keys.append(key)
        docs.append(doc)
        roles.append(np.broadcast_to(np.asarray(role, np.int32), len(key)))

    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    cut = _Cut(values, sizes, high)
    add(cut.keys(cut.content, cut.place), ids[cut.owner], np.where(sizes < SMALL, INDEX, INDEX | OWN)[cut.owner])
    # small sets: one-deletion neighbourhoods in the index, and the cheapest mix of probes
    small = sizes[np.searchsorted(cut.base, cut.code, side="right") - 1] < SMALL
    code = cut.code[small]
    add(cut.keys(cut.content[code] - cut.element[small], cut.place[code], True), ids[cut.owner[code]], INDEX)
    _small_probes(cut, np.flatnonzero(sizes < SMALL), 2 * sizes // 9 + 1, ids, add)
    # partners in the lower band
    low = high >> 1
    down = np.flatnonzero((low > 0) & (4 * sizes <= 5 * low))
    if len(down):
        ends = np.cumsum(sizes)
        picked = values[c.ranges((ends - sizes)[down], sizes[down])]
        cut = _Cut(picked, sizes[down], low[down])
        need = (sizes[down] + low[down]) // 9 + 1
        little = low[down] < SMALL
        all_of = ~little[cut.owner]
        add(cut.keys(cut.content[all_of], cut.place[all_of]), ids[down][cut.owner[all_of]], LOWER)
        _small_probes(cut, np.flatnonzero(little), need, ids[down], add)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(roles)


def _small_probes(cut: _Cut, owners: np.ndarray, need: np.ndarray, ids: np.ndarray, add) -> None:
    starts = np.searchsorted(cut.code[cut.order], np.arange(len(cut.content) + 1)) if len(owners) else None
    exact, inserted, removed = [], [], []
    for o in owners.tolist():
        codes = range(int(cut.base[o]), int(cut.base[o] + cut.m[o]))
        for code, e in zip(codes, _mix([int(cut.size[x]) for x in codes], int(need[o]))):
            if e >= 0:
                exact.append(code)
            if e == 1:
                inserted.append(code)
                removed += [(code, x) for x in cut.order[starts[code]:starts[code + 1]].tolist()]
    for codes, deleted in ((exact, False), (inserted, True)):
        if codes:
            at = np.array(codes)
            add(cut.keys(cut.content[at], cut.place[at], deleted), ids[cut.owner[at]], PROBE)
    if removed:
        at, x = np.array(removed).T
        add(cut.keys(cut.content[at] - cut.element[x], cut.place[at]), ids[cut.owner[at]], PROBE)


def segment_keys(docs: DataFrame, shingle: int) -> DataFrame:
    return _each(docs, "key long, doc_id long, role int",
                 lambda *x: [pa.array(y) for y in keys_of(*x)], shingle)


def cheapest_probes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Settles who probes: of ``key, doc_id, role, n`` (``n`` sets have the key) the rows that may probe become probes
    for as many as the bound on H asks for beyond the set's keys that no other set has, rarest first.

    ``sizes``: ``doc_id, n`` (the set's size). The window holds one set's segments.
    """
    scheme = F.when(F.col("role").bitwiseAND(OWN) > 0, OWN).when(F.col("role").bitwiseAND(LOWER) > 0, LOWER)
    each = Window.partitionBy("doc_id", "scheme")
    rows = (rows.withColumn("scheme", scheme).join(sizes.select("doc_id", F.col("n").alias("size")), "doc_id")
                .withColumn("rank", F.row_number().over(each.orderBy("n", "key")))
                .withColumn("shared", F.count(F.lit(1)).over(each)))
    high = F.expr("shiftleft(1L, length(bin(size))) - 1")          # largest size of the band
    high = F.when(F.col("scheme") == OWN, high).otherwise(F.shiftright(high, 1))
    bound = F.when(F.col("scheme") == OWN, 2 * F.col("size")).otherwise(F.col("size") + high)
    need = F.floor(bound / 9) + 1 - (F.floor(9 * high / 32) + 2 - F.col("shared"))
    probes = F.col("scheme").isNotNull() & (F.col("rank") <= need)
    return rows.withColumn("role", F.col("role").bitwiseAND(INDEX | PROBE).bitwiseOR(
        F.when(probes, PROBE).otherwise(0))).filter("role > 0").select("key", "doc_id", "role")


def probed_groups(rows: DataFrame) -> DataFrame:
    """``key, n, h`` of the keys with two members or more of which one probes and one is in the index; ``h`` digests
    members and roles."""
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles"),
        F.sum(F.xxhash64("doc_id", "role").cast("decimal(38,0)")).alias("h")).filter("n > 1 AND roles = 3")


def shared_keys(docs: DataFrame, copied: DataFrame, sizes: DataFrame, shingle: int) -> DataFrame:
    """``key, doc_id, role, n`` of all groups that are probed; sets equal to an earlier one left out."""
    rows = segment_keys(docs, shingle)
    again = c.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles"))
                          .filter("n > 1 AND roles & 1 > 0 AND roles > 1").select("key"), "keys")
    rows = (rows.join(again.hint("shuffle_hash"), "key").join(copied.select("doc_id"), "doc_id", "left_anti")
                .groupBy("key", "doc_id").agg(F.bit_or("role").alias("role")))
    rows = c.written(rows, "key-rows")
    c.removed(again)
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles")) \
                  .filter("n > 1 AND roles & 1 > 0 AND roles > 1").select("key", "n")
    probes = c.written(cheapest_probes(rows.join(counted, "key"), sizes), "probes")
    c.removed(rows)
    # many keys have the same members: one of them stands for all
    one = probed_groups(probes).groupBy("n", "h").agg(F.min("key").alias("key")).select("key", "n")
    groups = c.written(probes.join(one, "key"), "groups")
    c.removed(probes)
    return groups


# ------------------------------------------------------------------ comparing
def _sketch_bits(n: int) -> int:
    return max(64, 1 << (8 * int(n) - 1).bit_length()) if n else 64


def set_table(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, sketch, short, shingles`` of the wanted documents: a parity sketch of 8n bits or more, the same folded
    to a quarter, and the set."""
    def make(ids, values, bounds):
        sketches, shorts, sets = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = values[a:b]
            bits = _sketch_bits(b - a)
            odd = np.bincount((c.mixed(own) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
            packed = np.packbits(odd.astype(bool))
            sketches.append(packed.tobytes())
            shorts.append(_folded(packed, max(8, len(packed) // 4)).tobytes())
            sets.append(own.tobytes())
        return [pa.array(ids), pa.array(np.diff(bounds)), pa.array(sketches, pa.binary()), pa.array(shorts, pa.binary()),
                pa.array(sets, pa.binary())]
    rows = docs.join(wanted, "doc_id", "left_semi")
    return c.written(_each(rows, "doc_id long, n long, sketch binary, short binary, shingles binary", make, shingle), "sets")


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def differing(a: bytes, b: bytes) -> int:
    """A lower bound on the shingles that differ: each changes one parity."""
    size = min(len(a), len(b))
    x, y = _folded(np.frombuffer(a, np.uint8), size), _folded(np.frombuffer(b, np.uint8), size)
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n_a: int, n_b: int, low: int) -> bool:
    """False only for pairs below the threshold, by their sizes or by a lower bound on what differs."""
    return 5 * min(n_a, n_b) >= 4 * max(n_a, n_b) and 9 * low <= n_a + n_b


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` pairs with ``n_a, n_b, low`` (a lower bound on the shingles that differ), ``h`` (their number) and
    ``linked``; pairs that sketches rule out have no ``h`` and are not linked, all others are verified on whole sets."""
    def side(x: str, *cols: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(x), *[F.col(col).alias(f"{col}_{x}") for col in cols])

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [differing(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())]
            near = [may_link(*x) for x in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), low)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("a", "b", "n_a", "n_b")), pa.array(low, pa.int64()), pa.array(near, pa.bool_())],
                ["a", "b", "n_a", "n_b", "low", "near"])

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, linked = [], []
            for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                h.append(len(x) + len(y) - 2 * both)
                linked.append(PERCENT[0] * both >= PERCENT[1] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("a", "b", "n_a", "n_b", "low")), pa.array(h, pa.int64()),
                 pa.array(linked, pa.bool_())], ["a", "b", "n_a", "n_b", "low", "h", "linked"])

    first = c.written(pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(
        by_sketch, "a long, b long, n_a long, n_b long, low long, near boolean"), "sketched-pairs")
    exact = first.filter("near").join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").mapInArrow(
        by_set, "a long, b long, n_a long, n_b long, low long, h long, linked boolean")
    far = first.filter("NOT near").select("a", "b", "n_a", "n_b", "low", F.lit(None).cast("long").alias("h"),
                                          F.lit(False).alias("linked"))
    made = c.written(exact.unionByName(far), "compared-pairs")
    c.removed(first)
    return made


def with_hubs(groups: DataFrame) -> DataFrame:
    """``key, doc_id, role, hub``: the hub of a group is its member that is in the most groups."""
    weight = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w"))
    hubs = (groups.join(weight, "doc_id").groupBy("key")
                  .agg(F.max(F.struct("w", (-F.col("doc_id")).alias("d"))).alias("h"))
                  .select("key", (-F.col("h.d")).alias("hub")))
    return c.written(groups.join(hubs, "key").select("key", "doc_id", "role", "hub"), "hub-groups")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def star_pairs(groups: DataFrame) -> DataFrame:
    """Distinct (hub, member) pairs."""
    return groups.filter("doc_id <> hub").select(*_pair("doc_id", "hub")).distinct()


def undecided(groups: DataFrame, star: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, doc_id, role, component, size``: members of groups that may still hold a link between components.

    What differs is a distance: two members whose distances to the hub are further apart than the bound on H cannot be
    linked. A member that is not linked to the hub is at least ``low`` away from it, a linked one exactly ``h``; so
    members far from all linked ones are only compared among themselves, and linked ones stay only where a member of
    another component may be close to them.
    """
    rows = groups.select("*", *_pair("doc_id", "hub")).join(star, ["a", "b"], "left")
    is_hub = F.col("doc_id") == F.col("hub")
    # the hub's own size is that of the pairs it is in
    mine = F.when(F.col("doc_id") == F.col("a"), F.col("n_a")).otherwise(F.col("n_b"))
    hubs = F.when(F.col("doc_id") == F.col("a"), F.col("n_b")).otherwise(F.col("n_a"))
    rows = (rows.withColumn("linked", is_hub | F.coalesce("linked", F.lit(False)))
                .withColumn("h", F.when(is_hub, 0).otherwise(F.col("h")))
                .withColumn("size", mine).withColumn("hub_size", hubs)
                .join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
                .withColumn("component", F.coalesce("component", "doc_id")))
    per = rows.groupBy("key").agg(
        F.max("hub_size").alias("hub_n"), F.max(F.when(F.col("linked"), F.col("h"))).alias("far"),
        F.max(F.when(F.col("linked"), F.col("size"))).alias("top"),
        F.max(F.when(is_hub, F.col("component"))).alias("home"),
        F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    rows = rows.join(per, "key").withColumn("size", F.coalesce("size", "hub_n"))
    bound = F.floor((F.col("size") + F.greatest(F.coalesce("top", F.lit(0)), "hub_n")) / 9)
    # between the verified and the sketched bound take the larger
    apart = F.greatest(F.coalesce("h", F.lit(0)), F.col("low")) - F.col("far") > bound
    rows = rows.withColumn("close", ~F.col("linked") & (F.col("component") != F.col("home")) & ~apart)
    close = rows.groupBy("key").agg(F.max("close").alias("any_close"))
    rows = rows.join(close, "key").filter(~F.col("linked") | F.col("any_close"))
    rows = c.written(rows.select("key", "doc_id", "role", "component", "size"), "undecided")
    left = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"),
                                   F.max("component").alias("y"), F.bit_or("role").alias("roles")).filter(
        "x < y AND roles = 3").select("key", "n")
    made = c.written(rows.join(left, "key"), "undecided-groups")
    c.removed(rows)
    return made


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of each member (its own id, if it has no link)."""
    return (rows.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
                .withColumn("component", F.coalesce("component", "doc_id")))


def round_hubs(rows: DataFrame, number: int) -> DataFrame:
    """``key, hub, home``: up to ``HUBS`` members of each group, from different components, those with most members first;
    another member of a component in each round."""
    each = rows.groupBy("key", "component").agg(
        F.min(F.struct(F.xxhash64("doc_id", F.lit(number)).alias("at"), "doc_id")).alias("rep"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), "rep")
    return (each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS)
                .select("key", F.col("rep.doc_id").alias("hub"), F.col("component").alias("home")))


def joined_groups(rows: DataFrame) -> DataFrame:
    """Undecided groups with the same least member by hash as one group: its pairs are compared once. Equal member lists
    always meet, and lists that overlap do so as often as they are alike."""
    least = rows.groupBy("key").agg(F.min(F.xxhash64("doc_id")).alias("least"))
    return (rows.join(least, "key").groupBy(F.col("least").alias("key"), "doc_id")
                .agg(F.bit_or("role").alias("role"), F.max("component").alias("component"), F.max("size").alias("size")))


def _open(rows: DataFrame) -> DataFrame:
    """``key, n, parts`` of the groups that may still hold a link between components: members and components."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles"))
    return (parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.bit_or("roles").alias("roles"))
                 .filter("parts > 1 AND roles = 3").select("key", "n", "parts"))


def settled(rows: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of hubs over undecided groups (``key, doc_id, role, component, size``): the labels with the links they found,
    and the members of groups that rounds do not settle (with ``n``, their number in the group)."""
    rows, stuck, number = joined_groups(rows), None, 0
    rows = c.written(rows.join(_open(rows), "key"), "joined-groups")
    while True:
        hubs = c.written(round_hubs(rows, number), "round-hubs")
        pairs = rows.join(hubs, "key").filter("component <> home").select(*_pair("doc_id", "hub")).distinct()
        made = compared(pairs, sets)
        links = made.filter("linked").select("a", "b")
        if links.limit(1).count():
            labels = components(links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        # a hub has met every member of other components
        left = rows.join(hubs.select("key", F.col("hub").alias("doc_id")), ["key", "doc_id"], "left_anti")
        left = left.select("key", "doc_id", "role", "size", F.col("parts").alias("before"))
        left = c.written(_labelled(left, labels), "round-rows")
        after = c.written(left.join(_open(left), "key"), "round-groups")
        c.removed(hubs, made, left)
        halved = (2 * F.col("parts") <= F.col("before")) & (F.col("n") > SETTLED)
        more, rest = after.filter(halved).drop("before"), after.filter(~halved).drop("before")
        stuck = rest if stuck is None else stuck.unionByName(rest)
        rows, number = more, number + 1
        if not rows.limit(1).count():
            return labels, stuck


def block_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that may be linked among the undecided members of one group.

    A group is dealt into blocks of about ``BLOCK`` members (fewer, where their sketches are long) and every two blocks
    meet in one task, which compares sketches; only pairs that pass are rows.
    """
    longest = rows.groupBy("key").agg(F.max("size").alias("longest"))        # a sketch has up to half a byte an element
    members = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / (F.col("longest") / 2 + 8))))
    rows = rows.join(longest, "key").withColumn("blocks", F.ceil(F.col("n") / members).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")) \
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own",
                       "doc_id", "role", "component", "size").join(
        sets.select("doc_id", F.col("short").alias("sketch")), "doc_id")

    def of(block: pa.Table) -> pa.Table:
        get = {x: block.column(x).to_numpy() for x in ("doc_id", "role", "component", "size", "own", "p", "q")}
        sketches = [np.frombuffer(x, np.uint8) for x in block.column("sketch").to_pylist()]
        found_a, found_b = [], []
        widths = np.array([len(s) for s in sketches])
        for width in np.unique(widths):
            folded = {w: np.array([_folded(sketches[i], width) for i in np.flatnonzero(widths == w)])
                      for w in (width, 2 * width)}
            mine = np.flatnonzero(widths == width)
            for w, matrix in folded.items():
                theirs = np.flatnonzero(widths == w)
                if not len(theirs):
                    continue
                for k, i in enumerate(mine):
                    ok = (theirs > i) if w == width else np.ones(len(theirs), bool)
                    a, b = get["size"][i], get["size"][theirs]
                    ok &= get["component"][theirs] != get["component"][i]
                    ok &= 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
                    ok &= ((get["role"][i] | get["role"][theirs]) & PROBE) > 0
                    ok &= (get["p"][i] == get["q"][i]) | (get["own"][theirs] != get["own"][i])
                    rest = np.flatnonzero(ok)
                    if len(rest):
                        bits = np.bitwise_count(matrix[rest] ^ folded[width][k]).sum(1, dtype=np.int64)
                        hit = theirs[rest[9 * bits <= a + b[rest]]]
                        found_a += [get["doc_id"][i]] * len(hit)
                        found_b += get["doc_id"][hit].tolist()
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return rows.groupBy("key", "p", "q").applyInArrow(of, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest id reachable by links, itself included), one row per document.

    Texts are lower-cased (A-Z) and cut into words; a text of fewer than ``shingle`` words is one shingle; null texts
    and texts without words are empty sets, linked with nothing. Documents with equal sets are linked. Rows that repeat
    an id are one document (the greatest text); rows without an id are left out; other columns are ignored; an empty
    table gives an empty result.
    """
    c.prepare(docs.sparkSession)
    rows = c.keyed_documents(docs, id_col, text_col)
    signed = c.written(signatures(rows, shingle), "signatures")
    classes = (signed.filter("n > 0").groupBy("n", "d1", "d2")
                     .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    copied = c.written(signed.join(classes, ["n", "d1", "d2"]).filter("doc_id > first_id")
                             .select("doc_id", "first_id"), "copies")
    groups = shared_keys(rows, copied, signed, shingle)
    sets = set_table(rows, groups.select("doc_id").distinct(), shingle)
    keyed, groups = groups, with_hubs(groups)
    c.removed(keyed)
    star = compared(star_pairs(groups), sets)
    labels = components(star.filter("linked").select("a", "b"))
    rows = undecided(groups, star, labels)
    c.removed(groups)
    if rows.limit(1).count():
        labels, rows = settled(rows, sets, labels)
        rows = c.written(_labelled(rows.drop("component"), labels), "stuck-groups")
        more = compared(c.written(block_pairs(rows, sets), "block-pairs"), sets).filter("linked").select("a", "b")
        if more.limit(1).count():
            labels = components(more.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    firsts = copied.withColumnRenamed("first_id", "class_id")
    out = (signed.select("doc_id", F.col("n").alias("n_shingles")).join(firsts, "doc_id", "left")
                 .withColumn("id", F.coalesce("class_id", "doc_id")).join(labels, "id", "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
