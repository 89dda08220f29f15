"""File sources: plain, gzip, bzip2, empty, CRLF, bad UTF-8, missing,
numbering across many splits, byte offsets, natural name order."""

import bz2
import gzip
import os

import pytest

from logweft.sources.files import file_stats, read_logs, sort_paths


def _write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def test_plain_gz_bz2_empty(spark, tmpdir_path):
    d = tmpdir_path
    a = _write(os.path.join(d, "a.log"), b"one\r\ntwo\rstill two\n\nlast no newline")
    g = os.path.join(d, "b.log.gz")
    with gzip.open(g, "wb") as fh:
        fh.write(b"g1\ng2\n")
    b = os.path.join(d, "c.log.bz2")
    with bz2.open(b, "wb") as fh:
        fh.write(b"b1\nb\xffad\n")
    e = _write(os.path.join(d, "empty.log"), b"")
    res = read_logs(spark, [a, g, b, e])
    rows = res.lines.orderBy("file_order", "line_no").collect()
    got = [(os.path.basename(r.file), r.line_no, r.line) for r in rows]
    assert got == [
        ("a.log", 0, "one"), ("a.log", 1, "two\rstill two"), ("a.log", 2, ""),
        ("a.log", 3, "last no newline"),
        ("b.log.gz", 0, "g1"), ("b.log.gz", 1, "g2"),
        ("c.log.bz2", 0, "b1"), ("c.log.bz2", 1, "b�ad"),
    ]
    stats = {os.path.basename(r.file): r.lines for r in file_stats(res.lines).collect()}
    assert stats == {"a.log": 4, "b.log.gz": 2, "c.log.bz2": 2}


def test_missing_report_and_raise(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.log"), b"x\n")
    res = read_logs(spark, [a, os.path.join(tmpdir_path, "nope.log")], on_missing="report")
    assert res.lines.count() == 1
    assert [r.path.endswith("nope.log") for r in res.errors.collect()] == [True]
    with pytest.raises(FileNotFoundError):
        read_logs(spark, [os.path.join(tmpdir_path, "nope.log")])


def test_numbering_and_offsets_across_splits(spark, tmpdir_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    data = ("\n".join(lines) + "\n").encode()
    p1 = _write(os.path.join(tmpdir_path, "big.log"), data)
    p2 = _write(os.path.join(tmpdir_path, "big.log.2"), data[: len(data) // 2])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        res = read_logs(spark, [p2, p1], offsets=True)
        got = res.lines.select("file", "line_no", "byte_offset", "raw").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in got:
        by_file.setdefault(os.path.basename(r.file), []).append((r.line_no, r.byte_offset, r.raw))
    for name, content in (("big.log", data), ("big.log.2", data[: len(data) // 2])):
        want, pos = [], 0
        for i, raw in enumerate(content.split(b"\n")[:-1] if content.endswith(b"\n")
                                else content.split(b"\n")):
            want.append((i, pos, raw.decode()))
            pos += len(raw) + 1
        assert sorted(by_file[name]) == want, name
    assert res.files[0].endswith("big.log") and res.files[1].endswith("big.log.2")


def test_natural_order():
    names = ["app.log.10", "b.1", "app.log", "a.2", "app.log.2", "App.log.1"]
    assert sort_paths(names) == ["a.2", "app.log", "App.log.1", "app.log.2", "app.log.10", "b.1"]


def test_corrupt_file_is_skipped_when_tolerant(spark, tmpdir_path):
    good = _write(os.path.join(tmpdir_path, "good.log"), b"ok 1\nok 2\n")
    bad = _write(os.path.join(tmpdir_path, "bad.log.gz"), b"\x1f\x8b\x08\x00 this is not gzip data")
    res = read_logs(spark, [good, bad], on_missing="report")
    assert sorted(r.line for r in res.lines.collect()) == ["ok 1", "ok 2"]
    with pytest.raises(Exception):
        read_logs(spark, [good, bad]).lines.collect()


def test_natural_order_of_long_numbers(spark):
    from logweft.sources.files import sort_paths
    from logweft.sources.tables import with_file_order
    names = ["a.9", "a.10", "a." + "1" * 26, "a." + "1" * 25 + "2", "a.009", "a.b", "A.1"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = [r.file for r in with_file_order(df).orderBy("file_order").collect()]
    assert got == sort_paths(names) == ["A.1", "a.009", "a.9", "a.10", "a." + "1" * 26, "a." + "1" * 25 + "2", "a.b"]


def test_offsets_behind_a_byte_order_mark(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bom.log")
    with open(p, "wb") as fh:
        fh.write(b"\xef\xbb\xbfabc\nde\nf")
    rows = read_logs(spark, p, offsets=True).lines.orderBy("line_no").collect()
    assert [(r.raw, r.byte_offset) for r in rows] == [("abc", 0), ("de", 7), ("f", 10)]


def jobs_of(spark, build):
    """Jobs that ran while ``build`` made its DataFrame."""
    spark.sparkContext.setJobGroup("plan-time", "jobs before the first action")
    try:
        build()
        return list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-time"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_job_before_the_first_action(spark, tmpdir_path):
    from logweft.sources.render import document_log
    for k in range(2):
        with open(os.path.join(tmpdir_path, f"app.log.{k}"), "w") as fh:
            fh.write("x\ny\n")
    assert jobs_of(spark, lambda: read_logs(spark, tmpdir_path, offsets=True)) == []
    assert len(jobs_of(spark, lambda: document_log(spark, "/root/testdata/sf0.001"))) <= 1  # the schema of the table


def test_document_files_have_writers_of_their_own(spark):
    """No two of the files come from one task (hashed buckets met in one)."""
    from logweft.sources import render
    folder = render.document_files(spark, "/root/testdata/sf0.001")
    names = [f.rsplit("/", 1)[-1] for f in spark.read.text(folder).inputFiles()]
    assert len({n.split("-")[1] for n in names}) == len(names) == render.DOC_FILES


@pytest.mark.parametrize("compression", [None, "gzip", "bzip2"])
def test_document_files_are_written_in_parts_by_many_tasks(spark, monkeypatch, compression):
    """No task sorts, writes or compresses a whole bucket; the parts make one file in document order."""
    from logweft.operators import numbering
    from logweft.sources import render
    sizes, join = {}, render._joined_parts

    def watched(session, parts, path):
        for uri in session.read.text(parts).inputFiles():
            local = uri.removeprefix("file://").removeprefix("file:")
            sizes.setdefault(local.split("bucket=")[1].split("/")[0], []).append(os.path.getsize(local))
        join(session, parts, path)
        assert not os.path.exists(parts.removeprefix("file://").removeprefix("file:"))
    monkeypatch.setattr(numbering, "range_partitions", lambda df: 40)
    monkeypatch.setattr(render, "_joined_parts", watched)
    folder = render.document_files(spark, "/root/testdata/sf0.01", compression)
    assert len(sizes) == render.DOC_FILES and all(len(x) >= 4 for x in sizes.values())
    want = {}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text <> ''").orderBy("doc_id")
    for r in rows.select("doc_id", "text").collect():
        want.setdefault(str(r.doc_id % 8), []).append(r.text + "\n")
    opened = {None: open, "gzip": gzip.open, "bzip2": bz2.open}[compression]
    for uri in spark.read.text(folder).inputFiles():
        with opened(uri.removeprefix("file://").removeprefix("file:"), "rb") as fh:
            assert fh.read().decode() == "".join(want.pop(uri.split("bucket=")[1].split("/")[0]))
    assert not want
    lines = spark.read.text(folder)
    assert lines.count() == rows.selectExpr("sum(length(text) - length(replace(text, '\n', '')) + 1)").first()[0]


def tasks_of(spark, build):
    """Most tasks of a stage that ran while ``build`` did."""
    jobs = jobs_of(spark, build)
    tracker = spark.sparkContext.statusTracker()
    return max(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))


def test_files_grow_by_pieces_of_many_tasks(spark, tmpdir_path, monkeypatch):
    """No task copies a whole file; one that is there keeps its content, whatever place the new bytes begin at."""
    from logweft.sources import render
    monkeypatch.setattr(render, "PIECE_BYTES", 4096, raising=False)
    held = {}
    for name, size in (("a", 20_000), ("b", 4096), ("c", 5000), ("d", 8192), ("e", 0), ("f", 7)):
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            held[name] = os.urandom(size)
            fh.write(held[name])
    uri = lambda name: "file://" + os.path.join(tmpdir_path, name)
    pairs = [("a", "c"), ("b", "d"), ("e", "f")]                         # at an odd place, at a piece's end, nothing
    assert tasks_of(spark, lambda: render.append_files(spark, [(uri(x), uri(y)) for x, y in pairs])) >= 7
    for x, y in pairs:
        with open(os.path.join(tmpdir_path, y), "rb") as fh:
            assert fh.read() == held[y] + held[x]


def test_buckets_are_joined_by_pieces_of_many_tasks(spark, monkeypatch):
    from logweft.sources import render
    monkeypatch.setattr(render, "PIECE_BYTES", 1 << 14, raising=False)
    made = []
    assert tasks_of(spark, lambda: made.append(render.document_files(spark, "/root/testdata/sf0.001"))) >= 2 * render.DOC_FILES
    folder, want = made[0], {}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text <> ''").orderBy("doc_id")
    for r in rows.select("doc_id", "text").collect():
        want.setdefault(str(r.doc_id % 8), []).append(r.text + "\n")
    for name in spark.read.text(folder).inputFiles():
        with open(name.removeprefix("file://").removeprefix("file:"), "rb") as fh:
            assert fh.read().decode() == "".join(want.pop(name.split("bucket=")[1].split("/")[0]))
    assert not want
