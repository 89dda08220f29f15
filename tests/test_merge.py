"""Merge: order key, header back-fill, positions, saved text (FIXTURES §4)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from logweft.functions.lines import normalize_lines
from logweft.functions.timestamps import extract_timestamp
from logweft.operators import merge
from logweft.sources.tables import with_file_order


def table(spark, files):
    rows = [(name, i, text) for name, lines in files.items() for i, text in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, raw string")
    return extract_timestamp(with_file_order(normalize_lines(df)))


EPOCH = dt.datetime(1970, 1, 1)


def line_time(line):
    """The time of a test line in microseconds, None without one."""
    if line.startswith("Jan  1 00:00:00"):
        return (dt.datetime(1900, 1, 1) - EPOCH) // dt.timedelta(microseconds=1)
    try:
        return (dt.datetime.strptime(line[:19], "%Y-%m-%d %H:%M:%S") - EPOCH) // dt.timedelta(microseconds=1)
    except ValueError:
        return None


def python_merge(files):
    """The merge rule: lines ordered by (time, line number, file name). An untimed line has time 0, but in a file whose
    first timed line is among its first twelve, the lines above that one have its time."""
    rows = []
    for name, lines in files.items():
        times = [line_time(x) for x in lines]
        first = next((i for i, t in enumerate(times) if t), len(lines))
        for i, t in enumerate(times):
            key = times[first] if i < first < 12 else t or 0
            rows.append((key, i, name))
    return [(name, i) for _, i, name in sorted(rows)]


FILES = {
    "b.log": ["h1", "h2", "h3", "2024-01-01 00:00:05 b3", "2024-01-01 00:00:01 b4", "untimed",
              "Jan  1 00:00:00 syslog"],
    "a.log": ["2024-01-01 00:00:05 a0", "2024-01-01 00:00:05 a1", "2024-01-01 00:00:02 a2",
              "2024-01-01 00:00:05 a3"],
    "c.log": ["x"] * 12 + ["2024-01-01 00:00:03 c12"],
    "d.log": ["y"] * 11 + ["2024-01-01 00:00:04 d11"],
}


def test_merge_matches_model(spark):
    df = merge.merged_positions(table(spark, FILES), timed=True, partitions=3)
    got = [(r.file, r.line_no) for r in df.orderBy("merged_no").collect()]
    assert got == python_merge(FILES)
    nos = sorted(r.merged_no for r in df.select("merged_no").collect())
    assert nos == list(range(sum(len(v) for v in FILES.values())))


def test_backfill_limits(spark):
    df = merge.backfill_header(table(spark, FILES)).filter(F.col("line_no") == 0)
    keys = {r.file: r.ts_key for r in df.collect()}
    assert keys["c.log"] == 0          # first time at line 12: not filled
    assert keys["d.log"] != 0          # first time at line 11: filled
    assert keys["b.log"] == keys["a.log"]  # both 00:00:05


def test_single_file_keeps_file_order(spark):
    one = table(spark, {"a.log": FILES["a.log"]})
    assert not merge.several_files(one) and merge.several_files(table(spark, FILES))
    df = merge.merge_logs(one, timed=True, by_time=merge.several_files(one))
    assert [r.line_no for r in df.collect()] == [0, 1, 2, 3]


def test_save_merged_drops_blank_lines(spark, tmpdir_path):
    files = {"a.log": ["2024-01-01 00:00:02 a", ""], "b.log": ["2024-01-01 00:00:01 b"]}
    out = os.path.join(tmpdir_path, "merged")
    n = merge.save_merged(table(spark, files), out, timed=True, partitions=2)
    text = "".join(open(os.path.join(out, f)).read()
                   for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert n == 2 and text == "2024-01-01 00:00:01 b\n2024-01-01 00:00:02 a\n"


def test_time_jump_on_merged_log(spark):
    from logweft.operators import navigate
    files = {"a.log": [f"2024-01-01 00:{m:02d}:00 a" for m in range(0, 60, 7)],
             "b.log": ["head"] + [f"2024-01-01 00:{m:02d}:30 b" for m in range(0, 60, 5)]}
    merged = merge.merged_positions(table(spark, files), timed=True, partitions=3)
    rows = sorted((r.merged_no, r.ts) for r in merged.select("merged_no", "ts").collect())
    got = navigate.time_jump(merged, 3, 20, "m", by=(), position="merged_no").collect()
    # Python walk over the merged order
    base = next(i for i, t in rows[3:14] if t is not None)
    target = dict(rows)[base] + __import__("datetime").timedelta(minutes=20)
    want = next((i for i, t in rows if i > base and t is not None and t >= target), rows[-1][0])
    assert [(r.base_line, r.merged_no) for r in got] == [(base, want)]


def test_navigation_on_merged_log(spark):
    from logweft.operators import navigate
    merged = merge.merged_positions(table(spark, FILES), timed=True, partitions=3)
    n = merged.count()
    go = lambda k: [r.merged_no for r in navigate.goto_line(merged, k, by=(), position="merged_no").collect()]
    assert go(5) == [4] and go(10_000) == [n - 1]
    tail = sorted(r.merged_no for r in navigate.last_lines(merged, 3, by=(), position="merged_no").collect())
    assert tail == [n - 3, n - 2, n - 1]
    page = sorted(r.merged_no for r in navigate.line_page(merged, 2, 3, position="merged_no").collect())
    assert page == [2, 3, 4]


def test_lines_without_a_file_order_are_ranked(spark):
    df = table(spark, FILES).withColumn("file_order", F.when(F.col("file") == "c.log", None).otherwise(F.col("file_order")))
    rows = merge.merged_positions(df, timed=True).collect()
    assert sorted(r.merged_no for r in rows) == list(range(len(python_merge(FILES))))


def test_range_partitions_of_checkpointed_joins(spark):
    """A checkpointed join is measured by its files, not by the product guessed for it."""
    from logweft.operators.numbering import range_partitions, small_table
    spark.range(1000).write.mode("overwrite").parquet("/tmp/logweft-range-parts")
    a = spark.read.parquet("/tmp/logweft-range-parts")
    made = a
    for k in range(2):
        made = made.join(small_table(a.select(F.col("id").alias(f"k{k}")), 16).hint("merge"), F.col("id") == F.col(f"k{k}"))
    made = made.checkpoint()
    assert range_partitions(made) == range_partitions(made.join(a, "id")) == 4


def test_range_partitions_of_small_tables(spark):
    """A small table gets as many range partitions as there are cores, not the session's number of shuffle partitions."""
    from logweft.operators.numbering import range_partitions
    spark.range(1000).write.mode("overwrite").parquet("/tmp/logweft-range-parts")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert range_partitions(spark.read.parquet("/tmp/logweft-range-parts")) == spark.sparkContext.defaultParallelism
        unknown = spark.createDataFrame([(1,)], "id int")           # no statistics
        assert range_partitions(unknown) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
