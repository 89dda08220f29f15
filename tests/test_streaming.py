"""Streams: tail of growing files, folder of landed files; stream = batch."""

import os
import time

from logweft.functions.formats import classify_lines
from logweft.sources.files import read_logs
from logweft.streaming.streams import (lines_over_time_stream, parse_stream, pending_lines,
                                       stream_log_dir, tail_logs)


def _run(df, out, ck, fmt="parquet", mode="append"):
    q = (df.writeStream.format(fmt).option("path", out).option("checkpointLocation", ck)
           .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def test_tail_resume_half_line_and_truncate(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    with open(p, "w") as fh:
        fh.write("a1\na2\npart")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    df = tail_logs(spark, p, starting_position="earliest", max_bytes_per_trigger=4, chunk_bytes=2)
    _run(df, out, ck)          # a run of an availableNow trigger is one batch, within the cap
    read = lambda: sorted((r.byte_offset, r.line) for r in spark.read.parquet(out).collect())  # noqa
    assert read() == [(0, "a1")]
    _run(df, out, ck)
    assert read() == [(0, "a1"), (3, "a2")]
    with open(p, "a") as fh:
        fh.write("ial\nb\n")
    _run(df, out, ck)
    _run(df, out, ck)
    assert read() == [(0, "a1"), (3, "a2"), (6, "partial"), (14, "b")]
    with open(p, "w") as fh:
        fh.write("new\n")
    _run(df, out, ck)
    assert (0, "new") in read()


def test_tail_latest_skips_history(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    with open(p, "w") as fh:
        fh.write("old\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    df = tail_logs(spark, p)
    _run(df, out, ck)
    with open(p, "a") as fh:
        fh.write("new\n")
    _run(df, out, ck)
    assert [r.line for r in spark.read.parquet(out).collect()] == ["new"]


def test_refuses_compressed(spark):
    import pytest
    with pytest.raises(ValueError):
        tail_logs(spark, "/tmp/x.log.gz")


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"app.log.{i}"), "w") as fh:
            fh.write("".join(f'1.2.3.{j} - - [29/Jan/2024:13:4{i}:0{j} +0000] "GET /x HTTP/1.1" '
                             f'200 {j} "-"\n' for j in range(5)))
            fh.write('{"a": 1}\nplain\n')
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    _run(parse_stream(stream_log_dir(spark, src, max_files_per_trigger=1))
         .select("file", "line", "format", "status"), out, ck)
    streamed = sorted((os.path.basename(r.file), r.line, r.format, r.status)
                      for r in spark.read.parquet(out).collect())
    batch = read_logs(spark, [os.path.join(src, f) for f in os.listdir(src)]).lines
    batched = sorted((os.path.basename(r.file), r.line, r.format, r.status)
                     for r in parse_stream(batch).collect())
    assert streamed == batched and len(streamed) == 21


def test_pending_and_windows(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    with open(p, "w") as fh:
        fh.write("".join(f"2024-01-01 00:0{i}:00 x\n" for i in range(6)))
    df = tail_logs(spark, p, starting_position="earliest")
    q = (pending_lines(df, {p: 22 * 2}).writeStream.format("memory").queryName("pend")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    assert [r.pending_lines for r in spark.sql("select * from pend").collect()] == [4]
    q = (lines_over_time_stream(df, "2 minutes", "1 minute").writeStream.format("memory")
         .queryName("win").outputMode("append").trigger(processingTime="200 milliseconds")
         .start())
    try:
        q.processAllAvailable()
        for _ in range(50):  # the watermark moves on in the next (no-data) batch
            if spark.sql("select * from win").count() >= 2:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    got = sorted((r.period.minute, r.lines) for r in spark.sql("select * from win").collect())
    assert got[:2] == [(0, 2), (2, 2)]


def test_logs_from_table_on_a_stream(spark, tmpdir_path):
    import pytest
    from logweft.functions.timestamps import extract_timestamp
    from logweft.sources.tables import logs_from_table
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as fh:
        fh.write("2024-01-01 00:00:00 one\n2024-01-01 00:00:01 two\n")
    raw = spark.readStream.text(src)
    with pytest.raises(ValueError):
        logs_from_table(raw, "value", order_col="value")
    lines = extract_timestamp(logs_from_table(raw, "value"))
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    _run(lines.select("line", "ts_layout"), out, ck)
    got = sorted((r.line, r.ts_layout) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00 one", "iso_s"), ("2024-01-01 00:00:01 two", "iso_s")]


def test_tail_unreadable_file_is_reported_and_skipped(spark, tmpdir_path):
    good = os.path.join(tmpdir_path, "good.log")
    with open(good, "w") as fh:
        fh.write("g1\ng2\n")
    missing = os.path.join(tmpdir_path, "missing.log")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    _run(tail_logs(spark, [good, missing], starting_position="earliest"), out, ck)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.line for r in rows if r.error is None) == ["g1", "g2"]
    errs = [r for r in rows if r.error is not None]
    assert len(errs) == 1 and errs[0].file == missing


def test_tail_cap_with_long_lines_and_restart(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    text = "x" * 50 + "\n" + "".join(f"l{k}\n" for k in range(40))
    with open(p, "w") as fh:
        fh.write(text)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    sizes = {}

    def run(batches):
        df = tail_logs(spark, p, starting_position="earliest", max_bytes_per_trigger=20)

        def keep(batch, number):        # a batch that a stop cut short comes again under its number
            sizes[number] = [r.line for r in batch.collect()]
        q = (df.writeStream.foreachBatch(keep).option("checkpointLocation", ck)
               .trigger(processingTime="0 seconds").start())
        try:
            for _ in range(600):
                if len(sizes) >= batches:
                    break
                time.sleep(0.1)
        finally:
            q.stop()
    run(2)
    seen = len(sizes)
    run(seen + 2)          # restarted: the cap holds in its first batch
    lines = [x for number in sorted(sizes) for x in sizes[number]]
    assert lines == text.split("\n")[:len(lines)]
    assert sizes[0] == ["x" * 50]
    assert all(sum(len(x) + 1 for x in batch) <= 20 for number, batch in sizes.items() if number)
    assert len(lines) < len(text.split("\n"))


def test_tail_notices_a_longer_successor(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    with open(p, "w") as fh:
        fh.write("a1\na2\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    _run(tail_logs(spark, p, starting_position="earliest"), out, ck)
    with open(p, "w") as fh:
        fh.write("b1\nb2\nb3\nb4\n")
    _run(tail_logs(spark, p, starting_position="earliest"), out, ck)
    got = sorted(r.line for r in spark.read.parquet(out).collect())
    assert got == ["a1", "a2", "b1", "b2", "b3", "b4"]


def test_append_query_takes_lines_from_any_task(spark, monkeypatch, tmpdir_path):
    """Its log is written by the tasks that hold the lines, in any order; the windows are those of the whole log."""
    import duckdb
    from logweft import session
    from logweft.plans.queries import REGISTRY
    from logweft.sources import render
    folders, shared, lines = {}, session.shared_dir, render.app_lines
    monkeypatch.setattr(session, "shared_dir", lambda s, name: folders.setdefault(name, shared(s, name)))
    monkeypatch.setattr(render, "app_lines", lambda events: lines(events).repartition(7))
    query = REGISTRY["lines_over_time_append"]
    got = sorted((r.period, r.file, r.lines) for r in query.build(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    assert got == sorted(con.execute(query.oracle).fetchall()) and got
    folder = folders["append-files"].removeprefix("file:")
    assert sum(x.startswith("part-") for x in os.listdir(folder)) == 7


def test_drain_reads_to_the_end_fixed_at_the_start_in_capped_batches(spark, tmpdir_path):
    from logweft.streaming.streams import drain
    a, b = os.path.join(tmpdir_path, "a.log"), os.path.join(tmpdir_path, "b.log")
    with open(a, "w") as fh:
        fh.write("".join(f"line {k:04d}\n" for k in range(300)))            # 3,000 bytes
    with open(b, "w") as fh:
        fh.write("b\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")

    def write(df):
        with open(a, "a") as fh:                                             # grows with every batch
            fh.write("later\n")
        return df.filter("error IS NULL").select("line", "byte_offset").writeStream.format("parquet").option("path", out)

    assert drain(spark, [a, b, a + ".none"], ck, write, 1000, "earliest") == 3
    got = [r.line for r in spark.read.parquet(out).orderBy("byte_offset", "line").collect()]
    assert sorted(got) == sorted([f"line {k:04d}" for k in range(300)] + ["b"])
    # the next one goes on there: three lines that came meanwhile, and nothing twice
    assert drain(spark, [a, b], ck, write, 1000, "earliest") == 1
    lines = [r.line for r in spark.read.parquet(out).collect()]
    assert len(lines) == 304 and lines.count("later") == 3


def test_a_rotated_file_with_the_same_long_header_is_read_from_its_start(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    header = "#" * 3000 + "\n"
    with open(p, "w") as fh:
        fh.write(header + "old 1\nold 2\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    df = tail_logs(spark, p, starting_position="earliest")
    _run(df, out, ck)
    os.rename(p, p + ".1")
    with open(p, "w") as fh:
        fh.write(header + "new 1\nnew 2\nnew 3\n")              # longer than what was read
    _run(df, out, ck)
    got = [r.line for r in spark.read.parquet(out).collect()]
    assert sorted(x for x in got if not x.startswith("#")) == ["new 1", "new 2", "new 3", "old 1", "old 2"]
    with open(p, "a") as fh:
        fh.write("new 4\n")
    _run(df, out, ck)
    assert spark.read.parquet(out).filter("line LIKE 'new%'").count() == 4
