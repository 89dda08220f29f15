"""Driver contract and plan shape (scale guards read from explain())."""

import io
import os
from contextlib import redirect_stdout

import __spark_entry__ as entry
from logweft.plans.queries import REGISTRY
from logweft.operators import navigate
from logweft.sources.files import read_logs
from logweft.sources.render import document_log
from logweft.sources.sinks import read_log_table, write_log_table

SF = "/root/testdata/sf0.001"
# On the smallest tables no document holds the word searched for, and no file has 500 lines to jump back from.
EMPTY_HERE = {"search_literal", "search_stream", "time_jump_backward"}


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["status_class", "requests"] and len(rows) > 0


def test_every_query_runs_and_oracles_are_named(spark):
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    for name, q in REGISTRY.items():
        assert qs[name] is q.build
        rows = q.build(spark, SF).count()
        assert (rows > 0) != (name in EMPTY_HERE), name


def test_numbering_does_not_shuffle_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.log")
    with open(p, "w") as fh:
        fh.write("x\n" * 100)
    text = plan(read_logs(spark, p).lines)
    assert "BroadcastHashJoin" in text
    assert "SinglePartition" not in text


def test_navigation_prunes_at_scan(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "table")
    write_log_table(document_log(spark, SF), out)
    df = read_log_table(spark, out)
    text = plan(navigate.line_page(df, 2, 3).select("file", "line"))
    assert "PushedFilters" in text and "line_no" in text.split("PushedFilters")[1][:200]
    assert "ReadSchema: struct<file:string,line_no:bigint,line:string>" in text


def test_line_and_timestamp_scan_stay_in_codegen(spark):
    from logweft.functions.timestamps import extract_timestamp
    df = extract_timestamp(document_log(spark, SF))
    df.collect()  # run this very plan, so explain shows the final adaptive plan
    text = plan(df, "simple")
    # normalisation + first-hit timestamp chain run in generated code
    assert "*(" in text
    codegen_lines = [x for x in text.splitlines() if "*(" in x and "Project" in x]
    assert any("AS line" in x for x in codegen_lines)
    assert any("coalesce(CASE WHEN RLIKE" in x for x in codegen_lines)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def _without_static_broadcast(spark, build):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build(), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_file_keyed_operators_do_not_shuffle_the_lines(spark, tmpdir_path):
    """With static broadcast off (as for a large table): no exchange of the lines on the file or a constant."""
    from pyspark.sql import functions as F
    from logweft.operators import merge
    from logweft.sources.tables import with_file_order
    out = os.path.join(tmpdir_path, "t")
    (document_log(spark, SF).withColumn("ts", F.timestamp_seconds(F.col("line_no") * 60)).write.parquet(out))
    log = spark.read.parquet(out)
    for build in (lambda: with_file_order(log), lambda: merge.backfill_header(log)):
        text = _without_static_broadcast(spark, build)
        assert "SinglePartition" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    text = _without_static_broadcast(spark, lambda: navigate.last_lines(log, 2))
    assert "Join" not in text and "WindowGroupLimit" in text
    text = _without_static_broadcast(spark, lambda: navigate.goto_line(log, 3))
    assert "Join" not in text and "WindowGroupLimit" in text
    text = _without_static_broadcast(spark, lambda: navigate.time_jump(log, 0, 5, "m"))
    assert "Exchange hashpartitioning" in text          # partial minima and maxima per file only
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "ENSURE_REQUIREMENTS" in line
    assert text.count("HashAggregate(keys=[file") >= 4 or text.count("SortAggregate(key=[file") >= 2
    numbered = log.withColumn("merged_no", F.col("line_no") + 1000 * F.col("file").cast("long"))
    text = _without_static_broadcast(spark, lambda: navigate.time_jump(numbered, 0, 5, "m", by=(), position="merged_no"))
    assert "Join" not in text and "hashpartitioning" not in text


def test_a_cluster_without_a_checkpoint_folder_is_an_error(spark, monkeypatch):
    import pytest
    from logweft import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
