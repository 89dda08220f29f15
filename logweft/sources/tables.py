"""Logs from any DataFrame with a text column (text piped in from elsewhere)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft.functions.lines import decode_lenient, line_start, normalize_lines, normalize_piece_col
from logweft.operators.numbering import (LONG_ROWS_BYTES, ROWS_IN_TASK, maybe_broadcast, range_partitions, rank_within,
                                         small_table, written_once)
from logweft.schema import TAB_SIZE

# Tasks for a core where texts are written from rows far smaller than they are.
TASKS_A_CORE = 4


def natural_key(name: Column | str) -> Column:
    """Natural file-name order key: the base name split on '.', digit tokens
    compared as numbers, others lower-cased; ``app.log < app.log.2 <
    app.log.10``. An ARRAY<STRING>, so it compares token by token."""
    c = F.col(name) if isinstance(name, str) else name
    base = F.element_at(F.split(c, "/"), -1)
    def token(t):
        digits = F.ltrim(t, F.lit("0"))  # a number: by its length, then its digits
        return F.when(t.rlike(r"^[0-9]+$"),
                      F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(t))
    return F.transform(F.split(base, r"\."), token)


def with_file_order(df: DataFrame, file_col: str = "file", out: str = "file_order") -> DataFrame:
    """Rank of each file in natural name order (0-based).

    Computed on the distinct file names only (one row per file), ranked
    without a global window (a counted number of at most ``ROWS_IN_TASK`` in
    one task), and joined back: broadcast when that number is within the bound.
    """
    if out in df.columns:
        df = df.drop(out)
    files = written_once(df.select(F.col(file_col).alias("__ofile")).distinct().filter(F.col("__ofile").isNotNull()), "file-names")
    names = files.count()
    ranks = rank_within(files, [natural_key("__ofile"), "__ofile"], out=out, partitions=1 if names <= ROWS_IN_TASK else None)
    ranks = maybe_broadcast(ranks.select("__ofile", F.col(out).cast("int").alias(out)), names, 264)
    return (df.join(ranks, F.col(file_col).eqNullSafe(F.col("__ofile")), "left")
              .drop("__ofile"))


# Operators whose plan would run jobs (or wait for them) if its partitions were asked for.
_WIDE = re.compile(r"\b(Join|Aggregate|Distinct|Deduplicate|Window|Sort|Repartition\w*|RebalancePartitions|"
                   r"Union|Intersect|Except|GlobalLimit|FlatMap\w*|InMemoryRelation)\b")


def scan_partitions(df: DataFrame) -> int | None:
    """Partitions of a plan that is a scan with projections and filters (no
    job); None for any other plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if _WIDE.search(re.sub(r"#\d+|\[[^\n]*", "", plan.toString())):
        return None
    return df._jdf.rdd().getNumPartitions()


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread an input that arrives in fewer partitions than the cluster has
    cores (one small file, one gzip file) over all of them. Decided at plan
    time, without a job, from the partition count given or that of a bare
    scan; a wide input (the normal case at scale) is left as it is, with no
    shuffle."""
    if df.isStreaming:
        return df  # a stream's partitions come from its source per batch
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = scan_partitions(df) if partitions is None else partitions
    return df.repartition(cores) if n is not None and n < cores else df


def logs_from_table(df: DataFrame, text_col: str | Column = "text", file_col: str | None = None,
                    order_col: str | Column | None = None, file_order: bool = False,
                    keep: tuple[str, ...] = (), numbered: bool = True, part_col: str | None = None) -> DataFrame:
    """A log table (``file, file_order, line_no, byte_offset, raw, line``).

    Three shapes of input:

    * ``order_col`` is None: every row holds a whole text (a document, a
      file's content, a chat message); it is split on ``\\n`` only and the
      line number is the position in the text. A text ending in ``\\n`` has
      no phantom blank last line; an empty text has no lines.
    * ``order_col`` given: every row is already one line; its number is its
      rank by ``order_col`` inside ``file_col``, computed without a
      file-wide window (see :func:`logweft.operators.numbering.rank_within`).
      ``numbered=False`` skips that step (``line_no`` NULL) for jobs that
      only aggregate lines and need no order. ``text_col`` may be an
      expression: it is evaluated after the numbering, which then moves the
      columns of ``df`` and not the lines (for lines far longer than those).
    * ``part_col`` given: a file's text comes in parts, cut anywhere between
      characters, which follow one another by ``part_col``; no task holds a
      text or a line whole. The lines are those of the text put together; one
      that parts cut has a row for each piece, with the part's number in
      ``piece``, whose ``raw`` and ``line`` joined in that order are the line's.
      Runs two jobs at call time (the parts are written, their ends counted).
    """
    file_expr = (F.col(file_col) if file_col else F.lit("stdin")).cast("string")
    if df.isStreaming and order_col is not None and numbered:
        raise ValueError("a stream has no global line order: pass numbered=False "
                         "(byte offsets or event times order streamed lines)")
    if df.isStreaming and file_order:
        raise ValueError("file_order needs the whole file list: not available on a stream")
    if part_col is not None:
        if df.isStreaming or order_col is not None:
            raise ValueError("parts of texts come from a table that is no stream, and hold no lines to be ordered")
        lines = _lines_of_parts(df, text_col, file_expr, part_col, keep)
        lines = with_file_order(lines) if file_order else lines.withColumn("file_order", F.lit(None).cast("int"))
        return lines.select("file", "file_order", "line_no", "byte_offset", "raw", "line", "piece", *keep)
    df = spread(df)
    if order_col is None:
        text_c = F.col(text_col) if isinstance(text_col, str) else text_col
        text = F.regexp_replace(text_c, "\n\\z", "")
        parts = F.when(text_c == "", F.array().cast("array<string>")) \
                 .otherwise(F.split(text, "\n", -1))
        lines = df.select(file_expr.alias("file"), *keep,
                          F.posexplode(parts).alias("line_no", "raw"))
        lines = lines.withColumn("line_no", F.col("line_no").cast("bigint"))
    else:
        order = F.col(order_col) if isinstance(order_col, str) else order_col
        if isinstance(text_col, str):
            base = df.select(file_expr.alias("file"), *keep, F.col(text_col).alias("raw"), order.alias("__order"))
        else:
            base = df.select("*", file_expr.alias("__file"), order.alias("__order"))
        if numbered:
            lines = rank_within(base, ["__order"], ["file" if isinstance(text_col, str) else "__file"], out="line_no")
        else:
            lines = base.withColumn("line_no", F.lit(None).cast("bigint"))
        if isinstance(text_col, str):
            lines = lines.drop("__order")
        else:
            # rows far smaller than their texts: by their bytes they would be as many tasks as cores, or a few more
            tasks = max(range_partitions(base), TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
            lines = lines.repartition(tasks, "__order") if numbered else lines
            lines = lines.select(F.col("__file").alias("file"), *keep, text_col.alias("raw"), "line_no")
    lines = lines.withColumn("byte_offset", F.lit(None).cast("bigint"))
    lines = normalize_lines(lines)
    if file_order:
        lines = with_file_order(lines)
    else:
        lines = lines.withColumn("file_order", F.lit(None).cast("int"))
    return lines.select("file", "file_order", "line_no", "byte_offset", "raw", "line", *keep)


def _lines_of_parts(df: DataFrame, text_col: str | Column, file_expr: Column, part_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Pieces of the lines of texts in parts (see :func:`logs_from_table`).

    What a piece needs to know of the others of its line (its number, whether
    it begins or ends the line, the column it starts at) follows from a few
    numbers of the first and last piece of each part, all others are whole
    lines; only these numbers of a file or line come together in a task.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    parts = written_once(df.select(file_expr.alias("file"), *keep, F.col(part_col).alias("piece"),
                                   F.coalesce(text, F.lit("")).alias("__text")), "parts", LONG_ROWS_BYTES)
    cut = F.split("__text", "\n", -1)
    ends = parts.select("file", "piece", (F.size(cut) - 1).alias("__breaks"), F.posexplode(cut).alias("__at", "raw"))
    ends = ends.filter((F.col("__at") == 0) | (F.col("__at") == F.col("__breaks")))
    c = decode_lenient("raw")
    restarts, moved = line_start(c)
    ends = ends.select("file", "piece", "__breaks", "__at", (c == "").alias("__none"), (~c.rlike("[^\r]")).alias("__bare"),
                       restarts.alias("__restarts"), moved.alias("__moved"))
    in_file = Window.partitionBy("file").orderBy("piece", "__at")
    up_to, whole = in_file.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file")
    ends = ends.withColumn("line_no", F.sum(F.when(F.col("__at") > 0, F.col("__breaks")).otherwise(0)).over(up_to))
    in_line = Window.partitionBy("file", "line_no").orderBy("piece", "__at")
    before, behind = in_line.rowsBetween(Window.unboundedPreceding, -1), in_line.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("__sum", F.coalesce(F.sum("__moved").over(before), F.lit(0)))
    restart = F.last(F.when(F.col("__restarts"), F.col("__sum")), ignorenulls=True).over(before)
    nothing = F.min("__none").over(Window.partitionBy("file", "line_no")) & (F.col("line_no") == F.max("line_no").over(whole))
    facts = F.struct(F.coalesce(F.min("__bare").over(before), F.lit(True)).alias("first"),
                     F.coalesce(F.min("__bare").over(behind), F.lit(True)).alias("last"),
                     F.pmod(F.col("__sum") - F.coalesce(restart, F.lit(0)), F.lit(TAB_SIZE)).cast("int").alias("column"),
                     nothing.alias("nothing"))            # behind the last line feed there is no line
    ends = ends.withColumn("__facts", facts).groupBy("file", "piece").agg(
        F.min("line_no").alias("__from"), F.max("__breaks").alias("__breaks"),
        F.max(F.when(F.col("__at") == 0, F.col("__facts"))).alias("__head"),
        F.max(F.when(F.col("__at") > 0, F.col("__facts"))).alias("__tail"))
    ends = small_table(ends.withColumnsRenamed({"file": "__file", "piece": "__part"}), 256)
    inner = F.struct(F.lit(True).alias("first"), F.lit(True).alias("last"), F.lit(0).alias("column"), F.lit(False).alias("nothing"))
    lines = parts.join(ends, F.col("file").eqNullSafe(F.col("__file")) & (F.col("piece") == F.col("__part")))
    lines = lines.select("file", *keep, "piece", "__from", "__breaks", "__head", "__tail", F.posexplode(cut).alias("__at", "raw"))
    of = F.when(F.col("__at") == 0, F.col("__head")).when(F.col("__at") == F.col("__breaks"), F.col("__tail")).otherwise(inner)
    lines = lines.withColumn("__of", of).filter(~F.col("__of.nothing"))
    return lines.select("file", (F.col("__from") + F.col("__at")).cast("bigint").alias("line_no"), F.lit(None).cast("bigint").alias("byte_offset"),
                        "raw", normalize_piece_col("raw", F.col("__of.first"), F.col("__of.last"), F.col("__of.column")).alias("line"),
                        "piece", *keep)
