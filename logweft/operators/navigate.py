"""Navigation over numbered logs: go to a line, pages, head / tail, counts,
line facts, time jumps and lines per time unit.

Line numbers are contiguous from 0 inside a file, so "first n lines" or "a
page" is a range filter on ``line_no`` that a parquet log table prunes at
the scan; only "last n lines" and "go to line" need the per-file line count
(one small aggregate, one row per file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logweft.operators.numbering import small_table

_UNITS = {"m": "minute", "h": "hour", "d": "day",
          "minute": "minute", "hour": "hour", "day": "day"}


def line_counts(df: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Lines per file."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"))


def _top_lines(df: DataFrame, n: int, by: tuple[str, ...], position: str) -> DataFrame:
    """The ``n`` highest positions of each group (or of the whole log). A
    rank limit: every task keeps only ``n`` lines of a group before the
    shuffle (WindowGroupLimit); the whole log is a distributed top-n."""
    if not by:
        return df.orderBy(F.desc(position)).limit(n)
    order = Window.partitionBy(*by).orderBy(F.desc(position))
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def _last_line(df: DataFrame, by: tuple[str, ...], position: str = "line_no") -> DataFrame:
    return df.groupBy(*by).agg(F.max(position).alias("__last"))


def goto_line(df: DataFrame, n: int | str, by: tuple[str, ...] = ("file",),
              position: str = "line_no") -> DataFrame:
    """The line the user means by 1-based ``n`` in each file (or in the
    merged log: ``by=()``, ``position="merged_no"``), clamped to the first
    and last line. Not a number -> no rows."""
    try:
        target = int(n) - 1
    except (TypeError, ValueError):
        return df.limit(0)
    # The clamped line is the last one at or before n-1: that bound prunes at
    # the scan, and one line per file is kept before anything is shuffled.
    return _top_lines(df.filter(F.col(position) <= F.lit(max(target, 0))), 1, by, position)


def line_page(df: DataFrame, start: int, count: int, position: str = "line_no") -> DataFrame:
    """Lines ``start`` .. ``start+count-1`` (0-based) of every file (or of
    the merged log with ``position="merged_no"``)."""
    return df.filter(F.col(position).between(start, start + count - 1))


def head_lines(df: DataFrame, n: int, position: str = "line_no") -> DataFrame:
    """First ``n`` lines of every file (or of the merged log)."""
    return df.filter(F.col(position) < F.lit(n))


def last_lines(df: DataFrame, n: int, by: tuple[str, ...] = ("file",),
               position: str = "line_no") -> DataFrame:
    """Last ``n`` lines of every file (or of the merged log: ``by=()``)."""
    return _top_lines(df, n, by, position)


def line_facts(df: DataFrame) -> DataFrame:
    """What a footer shows for a line: file name, time, 1-based number."""
    name = F.element_at(F.split(F.col("file"), "/"), -1)
    return df.select(F.col("file"), name.alias("file_name"), F.col("ts"),
                     (F.col("line_no") + 1).alias("line_number"))


def _interval(steps: int, unit: str) -> F.Column:
    u = _UNITS[unit]
    if u == "day":
        return F.make_dt_interval(F.lit(0), F.lit(24 * steps))
    if u == "hour":
        return F.make_dt_interval(F.lit(0), F.lit(steps))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(steps))


def time_jump(df: DataFrame, line_no: int, steps: int, unit: str,
              by: tuple[str, ...] = ("file",), position: str = "line_no") -> DataFrame:
    """Where a jump of ``steps`` minutes / hours / days from line ``line_no``
    lands, in every file at once (or, with ``by=()`` and
    ``position="merged_no"``, in the merged log).

    The base is the first timed line among ``line_no`` .. ``line_no+10``
    (no base -> no row). Forward: the first later line whose time is at or
    after base + delta, else the last line. Backward: the nearest earlier
    line (above line 0) whose time is at or before base + delta, else line
    0. Three small aggregates joined per file.
    """
    if unit not in _UNITS:
        raise ValueError(f"unit must be one of m, h, d: {unit!r}")
    pos = F.col(position)
    keys = list(by)
    # Untimed lines are skipped by NULL orderings / NULL values inside the
    # aggregates, not by a filter on ``ts`` (which Catalyst would push down,
    # copying the timestamp expression into the filter).
    timed_pos = F.when(F.col("ts").isNotNull(), pos)
    near = df.filter(pos.between(line_no, line_no + 10))
    base = (near.groupBy(*keys)
              .agg(F.min_by(F.struct(pos.alias("p"), F.col("ts").alias("ts")), timed_pos).alias("b"))
              .filter(F.col("b").isNotNull())
              .select(*keys, F.col("b.p").alias("base_line"),
                      (F.col("b.ts") + _interval(steps, unit)).alias("target_ts")))
    # One row per file (one row in all for the whole log), computed once.
    base = small_table(base, 32 + 256 * len(keys))
    if not keys:
        return _jump_whole_log(df, base, steps, position)
    last = _last_line(df, tuple(keys), position)
    cand = df.join(base, keys)
    if steps > 0:
        hit = F.when((pos > F.col("base_line")) & (F.col("ts") >= F.col("target_ts")), pos)
        hits = cand.groupBy(*keys).agg(F.min(hit).alias("hit"))
        fallback = F.col("__last")
    else:
        hit = F.when((pos < F.col("base_line")) & (pos > 0) & (F.col("ts") <= F.col("target_ts")), pos)
        hits = cand.groupBy(*keys).agg(F.max(hit).alias("hit"))
        fallback = F.lit(0).cast("bigint")
    return (base.join(last, keys).join(hits, keys, "left")
                .select(*keys, "base_line", "target_ts",
                        F.coalesce(F.col("hit"), fallback).alias(position)))


def _jump_whole_log(df: DataFrame, base: DataFrame, steps: int, position: str) -> DataFrame:
    """The jump in the merged log: the one base row becomes literals of a
    single map-side combined aggregate (no join)."""
    pos = F.col(position)
    found = base.first()
    if found is None:
        return base.withColumn(position, F.lit(None).cast("bigint"))
    target = base.select(F.unix_micros("target_ts")).first()[0]
    at, line = F.timestamp_micros(F.lit(target)), F.lit(found["base_line"])
    if steps > 0:
        hit = F.coalesce(F.min(F.when((pos > line) & (F.col("ts") >= at), pos)), F.max(pos))
    else:
        hit = F.coalesce(F.max(F.when((pos < line) & (pos > 0) & (F.col("ts") <= at), pos)),
                         F.lit(0).cast("bigint"))
    return df.agg(hit.alias(position)).select(line.cast("bigint").alias("base_line"),
                                              at.alias("target_ts"), position)


def lines_over_time(df: DataFrame, unit: str = "h", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Timed lines per minute / hour / day (and file)."""
    u = _UNITS[unit]
    # count(ts) is 0 exactly for the untimed group; dropped after the
    # aggregate (a filter on ``ts`` would repeat the timestamp scan).
    return (df.groupBy(*by, F.date_trunc(u, F.col("ts")).alias("period"))
              .agg(F.count("ts").alias("lines"))
              .filter(F.col("lines") > 0))
