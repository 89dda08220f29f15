"""Pages, go-to and time jumps through a sparse index against the same operators on the whole log."""

import os

import pytest

from logweft.functions.timestamps import extract_timestamp
from logweft.operators import line_index, navigate
from logweft.sources import ranges
from logweft.sources.files import read_logs

LINE = "2024-05-01 {:02d}:{:02d}:{:02d},000 event {}"


def write_logs(folder, n=2000):
    for name, step in (("app.log.0", 1), ("app.log.1", 3)):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write("# header\n# header\n")
            for k in range(n // step):
                t = k * step * 20
                fh.write(LINE.format(t // 3600, t // 60 % 60, t % 60, k) + "\n")
    with open(os.path.join(folder, "empty.log"), "w"):
        pass


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture()
def logs(spark, tmpdir_path):
    write_logs(tmpdir_path)
    index = line_index.line_index(spark, tmpdir_path, every=50, timed=True).cache()
    return index, extract_timestamp(read_logs(spark, tmpdir_path, offsets=True).lines).cache()


def test_pages_and_goto(spark, logs):
    index, whole = logs
    cols = ("file", "line_no", "byte_offset", "line")
    for start, count in ((0, 5), (49, 2), (640, 100), (1990, 50), (5000, 3)):
        assert rows(line_index.page_by_index(spark, index, start, count), *cols) == rows(navigate.line_page(whole, start, count), *cols)
    for n in (1, 50, 51, 700, 99_999, 0, "x"):
        assert rows(line_index.goto_by_index(spark, index, n), *cols) == rows(navigate.goto_line(whole, n), *cols)


def test_time_jumps(spark, logs):
    index, whole = logs
    cols = ("file", "base_line", "target_ts", "line_no")
    for jump in ((0, 5, "m"), (0, 1, "h"), (10, 9, "d"), (600, -1, "h"), (600, -2, "m"), (300, -9, "d"), (45, 1, "m")):
        got = rows(line_index.time_jump_by_index(spark, index, *jump), *cols)
        assert got == rows(navigate.time_jump(whole, *jump), *cols), jump


def test_a_page_of_a_large_file_reads_little(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "large.log")
    with open(path, "w") as fh:
        for k in range(400_000):
            fh.write(f"{k:07d} " + "x" * 120 + "\n")
    index = line_index.line_index(spark, path).cache()
    assert index.count() == 400
    planned = []
    real = ranges.read_ranges
    monkeypatch.setattr(ranges, "read_ranges", lambda spark, plan, **kw: planned.append(plan) or real(spark, plan, **kw))
    got = line_index.page_by_index(spark, index, 250_990, 40).collect()
    assert sorted(r.line_no for r in got) == list(range(250_990, 251_030))
    assert all(r.raw.startswith(f"{r.line_no:07d} ") for r in got)
    assert sum(r.end - r.start for plan in planned for r in plan) < 300_000 < os.path.getsize(path) // 100
    assert all(r.exact for plan in planned for r in plan)


def test_kept_index_and_compressed_files(spark, logs, tmpdir_path):
    index, whole = logs
    line_index.write_index(index, os.path.join(tmpdir_path, "index"))
    kept = spark.read.parquet(os.path.join(tmpdir_path, "index"))
    assert kept.schema.simpleString().count("bigint") == 5
    assert rows(line_index.page_by_index(spark, kept, 10, 3), "file", "line") == rows(navigate.line_page(whole, 10, 3), "file", "line")
    import gzip
    with gzip.open(os.path.join(tmpdir_path, "z.gz"), "wb") as fh:
        fh.write(b"x\n")
    with pytest.raises(ValueError):
        line_index.line_index(spark, os.path.join(tmpdir_path, "z.gz"))
