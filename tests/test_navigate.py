"""Navigation: go to line, pages, head / tail, time jumps."""

import datetime as dt

from pyspark.sql import functions as F

from log_lines_helper import lines_df
from logweft.functions.timestamps import extract_timestamp
from logweft.operators import navigate

LINES = ["header", "2024-01-01 00:00:00 a", "2024-01-01 00:30:00 b", "untimed",
         "2024-01-01 01:10:00 c", "2024-01-01 03:00:00 d", "tail"]


def test_goto_and_pages(spark):
    df = lines_df(spark, LINES)
    go = lambda n: [r.line_no for r in navigate.goto_line(df, n).collect()]
    assert go(3) == [2] and go(100) == [6] and go(0) == [0] and go("x") == []
    assert [r.line_no for r in navigate.line_page(df, 2, 3).orderBy("line_no").collect()] == [2, 3, 4]
    assert [r.line_no for r in navigate.head_lines(df, 2).orderBy("line_no").collect()] == [0, 1]
    assert [r.line_no for r in navigate.last_lines(df, 2).orderBy("line_no").collect()] == [5, 6]
    assert navigate.line_counts(df).collect()[0].lines == 7


def test_time_jump(spark):
    df = extract_timestamp(lines_df(spark, LINES))
    j = lambda n, s, u: navigate.time_jump(df, n, s, u).collect()
    assert [r.line_no for r in j(0, 1, "h")] == [4]      # base line 1, first >= 01:00
    assert [r.line_no for r in j(0, 5, "h")] == [6]      # nothing later: last line
    assert [r.line_no for r in j(5, -1, "h")] == [4]     # base 03:00, nearest <= 02:00 going up
    assert [r.line_no for r in j(5, -2, "h")] == [2]     # nearest <= 01:00 going up
    assert [r.line_no for r in j(5, -1, "d")] == [0]     # nothing earlier: line 0
    assert j(6, 1, "m") == []                            # no timed line in 6..16


def test_lines_over_time_and_facts(spark):
    df = extract_timestamp(lines_df(spark, LINES))
    per = {r.period.replace(tzinfo=None): r.lines for r in navigate.lines_over_time(df, "h").collect()}
    assert per == {dt.datetime(2024, 1, 1, 0): 2, dt.datetime(2024, 1, 1, 1): 1,
                   dt.datetime(2024, 1, 1, 3): 1}
    facts = navigate.line_facts(df.withColumn("file", F.lit("/var/log/app.log"))).collect()
    assert {(r.file_name, r.line_number) for r in facts} >= {("app.log", 1), ("app.log", 7)}
