"""Merging logs that are mostly in order: zone maps decide what must move.

A log's lines come in blocks (a file's lines, so many at a time). A zone map
holds each block's first and last merge key, its lines, and whether it is in
key order. Blocks whose key intervals touch no other block's take their places
in the merged log from counts alone: a line's position is the lines of all
earlier zones plus its place in its own. Only lines of blocks that overlap (or
are out of order) are ranked, and of those only keys are shuffled for it.

So rotated logs, or logs of different days, are merged without moving a line;
logs that were written at the same time rank as many keys as there are lines.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from logweft.operators.numbering import PARTITION_BYTES, ROWS_IN_TASK, maybe_broadcast, range_partitions, rank_within, written_once

#: Lines of a block, and the most blocks that a table of 256 MiB partitions gets (the zone map is broadcast).
RUN_LINES = 4096
MAX_ZONES = 1_000_000
#: Zones that one task places; more are range-partitioned.
ZONES_IN_TASK = ROWS_IN_TASK
_LINES_PER_PARTITION = PARTITION_BYTES // 100
_PIECE = "file_order int, block bigint, first_line bigint, lines bigint, lo bigint, hi bigint"


def run_lines(df: DataFrame) -> int:
    """Lines of a block, so that the zone map stays within ``MAX_ZONES``."""
    lines = range_partitions(df) * _LINES_PER_PARTITION
    return max(RUN_LINES, -(-lines // MAX_ZONES))


def _pieces(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Stretches of consecutive lines of one block, in key order, as rows came."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        order, line, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(n, bool)
        new[1:] = (order[1:] != order[:-1]) | (line[1:] != line[:-1] + 1) | (line[1:] // run != line[:-1] // run) | (key[1:] < key[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (order[first], line[first] // run, line[first], last - first + 1, key[first], key[last])],
            [x.split()[0] for x in _PIECE.split(", ")])


def zone_map(keyed: DataFrame, run: int) -> DataFrame:
    """One row per block of a log with ``ts_key``: ``file_order, block,
    first_line, lines, lo, hi`` (merge keys as structs), ``sorted``."""
    rows = keyed.select(F.col("file_order").cast("int"), F.col("line_no").cast("bigint"), F.col("ts_key").cast("bigint"))
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, run), _PIECE)
    # pieces of a block (one, if its lines came in order): in line order they must go on where the last one ended
    joined = pieces.groupBy("file_order", "block").agg(
        F.sort_array(F.collect_list(F.struct("first_line", "lines", "lo", "hi"))).alias("p"))
    follows = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (
        F.get("p", i)["first_line"] == F.get("p", i - 1)["first_line"] + F.get("p", i - 1)["lines"])
        & (F.get("p", i)["lo"] >= F.get("p", i - 1)["hi"]))
    last = F.element_at("p", -1)
    zone = joined.select(
        "file_order", "block", F.col("p")[0]["first_line"].alias("first_line"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["lines"]).alias("lines"),
        (last["first_line"] + last["lines"] - 1).alias("last_line"),
        F.array_min("p.lo").alias("lo"), F.array_max("p.hi").alias("hi"),
        F.when(F.size("p") == 1, True).otherwise(follows).alias("sorted"))
    return zone.select("file_order", "block", "first_line", "lines", "sorted",
                       _key("lo", "first_line").alias("lo"), _key("hi", "last_line").alias("hi"))


def _key(ts: str, line: str) -> Column:
    return F.struct(F.col(ts).alias("ts_key"), F.col(line).alias("line_no"), F.col("file_order").alias("file_order"))


def _placed(zones: DataFrame, counted: int) -> DataFrame:
    """Zones with their group (zones that overlap, directly or through others),
    whether it is ``apart`` (one zone, in order), and the lines of earlier
    groups: ``before`` of all, ``apart_before`` of those apart.

    More than ``ZONES_IN_TASK`` zones are range-partitioned by first key; what
    comes from earlier partitions is one row for each. Fewer are one part,
    whose windows need no shuffle but the one that brings them together.
    """
    lo = F.col("lo")
    if counted <= ZONES_IN_TASK:
        return _placed_here(zones.repartition(1), Window.orderBy(lo))
    n = range_partitions(zones)
    # two range shuffles may sample different bounds
    ranged = written_once(zones.repartitionByRange(n, lo).sortWithinPartitions(lo).withColumn("part", F.spark_partition_id()), "zones")
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy(lo)
    earlier = ranged.groupBy("part").agg(F.max("hi").alias("top")).select("part", F.max("top").over(over_parts).alias("top"))
    rows = _opened(ranged.join(earlier, "part"), inside, F.col("top"))
    opened = rows.groupBy("part").agg(F.sum("opens").alias("n")).select("part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("base"))
    rows = rows.join(opened, "part").withColumn("group", F.col("base") + F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    groups = _groups(rows, F.min("part").alias("part"))
    sums = groups.groupBy("part").agg(F.sum("group_lines").alias("a"), F.sum("own").alias("b")).select(
        "part", F.coalesce(F.sum("a").over(over_parts), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(over_parts), F.lit(0)).alias("b"))
    groups = _before(groups.join(sums, "part"), Window.partitionBy("part").orderBy("group"), F.col("a"), F.col("b"))
    return rows.join(groups, "group").select(*_PLACED)


def _placed_here(zones: DataFrame, order: WindowSpec) -> DataFrame:
    """:func:`_placed` for zones in one partition."""
    none = F.lit(0).cast("bigint")
    rows = _opened(zones, order, None).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = _before(_groups(rows), Window.orderBy("group"), none, none)
    return rows.join(F.broadcast(groups), "group").select(*_PLACED)


_PLACED = ("file_order", "block", "first_line", "lines", "apart", "before", "apart_before")


def _opened(rows: DataFrame, order: WindowSpec, top: Column | None) -> DataFrame:
    """``opens``: 1 where a zone lies behind all earlier ones (those of earlier parts reach ``top``)."""
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reach", reach if top is None else F.greatest(top, reach))
    return rows.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), 1).otherwise(0))


def _groups(rows: DataFrame, *more: Column) -> DataFrame:
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("zones"), F.sum("lines").alias("group_lines"),
                                       F.min("sorted").alias("ordered"), *more)
    groups = groups.withColumn("apart", (F.col("zones") == 1) & F.col("ordered"))
    return groups.withColumn("own", F.when(F.col("apart"), F.col("group_lines")).otherwise(0))


def _before(groups: DataFrame, order: WindowSpec, lines: Column, apart: Column) -> DataFrame:
    """Lines of earlier groups of the window behind those of earlier parts: of all groups, and of those apart."""
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return groups.select("group", "apart", (lines + F.coalesce(F.sum("group_lines").over(earlier), F.lit(0))).alias("before"),
                         (apart + F.coalesce(F.sum("own").over(earlier), F.lit(0))).alias("apart_before"))


def key_table(keyed: DataFrame) -> DataFrame:
    """``file_order, line_no, ts_key`` of every line, written once: the zone map and the ranks read
    them more than once, and each time would search the lines for their times again."""
    return written_once(keyed.select(F.col("file_order").cast("int"), F.col("line_no").cast("bigint"), F.col("ts_key").cast("bigint")),
                        "merge-keys")


def merged_by_zones(keyed: DataFrame, out: str = "merged_no", run: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``keyed`` (a log table with ``ts_key``) with the position of each line in
    the order of (``ts_key``, ``line_no``, ``file_order``).

    Jobs at call time: the keys (one narrow pass over the log, unless its
    :func:`key_table` is given), the zone map and, if zones overlap, the ranks
    of their lines' keys; wide rows are never written.
    """
    keys = key_table(keyed) if keys is None else keys
    run = run or run_lines(keyed)
    zones = written_once(zone_map(keys, run), "zone-map")
    counted = zones.count()
    zones = maybe_broadcast(written_once(_placed(zones, counted), "zones-placed"), counted, 64)
    block = F.floor(F.col("line_no") / run).cast("bigint")
    marks = zones.select(F.col("file_order").alias("__order"), F.col("block").alias("__block"), "first_line", "apart", "before", "apart_before")

    def marked(df: DataFrame) -> DataFrame:
        return df.join(marks, (F.col("file_order").cast("int") == F.col("__order")) & (block == F.col("__block")))

    columns = keyed.columns
    kinds = {r.apart for r in zones.select("apart").distinct().collect()}      # two rows at most
    clean = marked(keyed).filter("apart").select(*columns, (F.col("before") + F.col("line_no") - F.col("first_line")).alias(out))
    if False not in kinds:
        return clean
    ranked = rank_within(marked(keys).filter("NOT apart").select(
        F.col("ts_key").alias("__k"), F.col("line_no").alias("__l"), F.col("file_order").alias("__f"), "apart_before"),
        ["__k", "__l", "__f"], out="__rank")
    mixed = marked(keyed).filter("NOT apart") if True in kinds else keyed
    mixed = mixed.join(ranked.select("__f", "__l", (F.col("__rank") + F.col("apart_before")).alias(out)),
                       (F.col("file_order") == F.col("__f")) & (F.col("line_no") == F.col("__l"))).select(*columns, out)
    return clean.unionByName(mixed) if True in kinds else mixed
