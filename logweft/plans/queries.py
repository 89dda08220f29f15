"""Named queries over the driver's tables, each with its DuckDB oracle.

Every query renders log text from a driver table (``events``,
``documents``, ``conversations``), runs the library's operators on the
*text*, and returns the result over the whole table. The oracle SQL never
parses the text: it reads the original columns, so it checks the operators
independently. Queries whose rule needs regex features DuckDB lacks
(look-behind) have no oracle and are checked against a brute-force Python
model in the tests instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logweft.functions import entities, formats, lines as linefns, timestamps
from logweft.operators import line_index, merge, navigate, search
from logweft.session import configure
from logweft.sources import render
from logweft.sources.files import file_stats, read_logs
from logweft.sources.tables import logs_from_table, with_file_order
from logweft.streaming.streams import (drain, lines_over_time_stream, parse_stream, pending_lines, search_stream,
                                       stream_log_dir, tail_logs)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        build.__name__ = f"build_{name}"
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn
    return wrap


def ntz(col: str) -> F.Column:
    """Result times as TIMESTAMP_NTZ (UTC wall clock), the oracle's type."""
    return F.col(col).cast("timestamp_ntz").alias(col)


# ---------------------------------------------------------------- oracle SQL
# The true values behind each rendered log, computed from the columns.
_STATUS_SQL = ("CASE event_type WHEN 'click' THEN 200 WHEN 'signup' THEN 201 "
               "WHEN 'purchase' THEN 302 WHEN 'view' THEN 304 WHEN 'error' THEN 500 ELSE 0 END")
_METHOD_SQL = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END"

_ACCESS = """access AS (
  SELECT 'access.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
         *
  FROM events)"""

_APP = """body AS (
  SELECT 'app.log.' || CAST(user_id % 4 AS VARCHAR) AS file, CAST(user_id % 4 AS INTEGER) AS file_order,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) + 2 AS BIGINT) AS line_no,
         date_trunc('millisecond', ts) AS ts, event_type
  FROM events),
hdr AS (
  SELECT f.file, f.file_order, CAST(r.h AS BIGINT) AS line_no, CAST(NULL AS TIMESTAMP) AS ts,
         CAST(NULL AS VARCHAR) AS event_type
  FROM (SELECT DISTINCT file, file_order FROM body) f, range(3) r(h)),
app AS (SELECT * FROM body UNION ALL SELECT * FROM hdr),
keyed AS (
  SELECT a.*, COALESCE(epoch_us(a.ts),
                       (SELECT epoch_us(b.ts) FROM body b WHERE b.file = a.file AND b.line_no = 3)) AS ts_key
  FROM app a)"""

_DOCLINES = """parts AS (
  SELECT CAST(doc_id AS VARCHAR) AS file,
         string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p
  FROM documents WHERE text <> ''),
doclines AS (
  SELECT file, CAST(i AS BIGINT) AS line_no, p[i + 1] AS raw, p[i + 1] AS line
  FROM (SELECT file, p, unnest(range(len(p))) AS i FROM parts))"""


def _access(spark, sf_dir):
    return formats.parse_access_log(render.access_log(spark, sf_dir))


def _app(spark, sf_dir):
    return timestamps.extract_timestamp(render.app_log(spark, sf_dir))


def _docs(spark, sf_dir):
    return render.document_log(spark, sf_dir)


# ------------------------------------------------------------ formats (F)
@query("status_class_counts", f"""
SELECT CASE WHEN substr(CAST(s AS VARCHAR), 1, 1) IN ('1','2','3','4','5')
            THEN substr(CAST(s AS VARCHAR), 1, 1) || 'xx' ELSE 'other' END AS status_class,
       count(*) AS requests
FROM (SELECT {_STATUS_SQL} AS s FROM events) t
GROUP BY 1
""")
def q_status_class_counts(spark, sf_dir):
    """Access log rendered from ``events`` -> classify -> parse -> requests per status class."""
    log = render.access_log(spark, sf_dir, numbered=False)
    return formats.status_class_counts(formats.parse_access_log(log))


@query("parse_access_log", f"""
WITH {_ACCESS}
SELECT file, line_no, 'common' AS format,
       '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip,
       '-' AS remote_log_name, '-' AS userid, {_METHOD_SQL} AS request_method,
       '/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path,
       ' HTTP/1.1' AS request_version, CAST({_STATUS_SQL} AS INTEGER) AS status,
       CAST(floor(abs(value)) AS BIGINT) AS length,
       '-" "agent/' || CAST(user_id AS VARCHAR) AS referrer,
       '-' AS referrer_clean, 'agent/' || CAST(user_id AS VARCHAR) AS user_agent_clean,
       date_trunc('second', ts) AS access_ts
FROM access
""")
def q_parse_access_log(spark, sf_dir):
    """Common access log: every field of every line, typed, with its time."""
    df = _access(spark, sf_dir)
    return df.select("file", "line_no", "format", "ip", "remote_log_name", "userid",
                     "request_method", "path", "request_version", "status", "length",
                     "referrer", "referrer_clean", "user_agent_clean", ntz("access_ts"))


@query("parse_access_log_combined", f"""
SELECT 'combined.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       'combined' AS format,
       '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip,
       strftime(ts, '%d/%b/%Y:%H:%M:%S') AS date, '+0000' AS timezone,
       {_METHOD_SQL} AS request_method, CAST({_STATUS_SQL} AS INTEGER) AS status,
       CAST(floor(abs(value)) AS BIGINT) AS length, '-' AS referrer,
       'agent/' || CAST(user_id AS VARCHAR) AS user_agent, 's' || CAST(user_id AS VARCHAR) AS session_id,
       CAST(event_id AS BIGINT) AS generation_time_micro,
       'host' || CAST(user_id % 3 AS VARCHAR) || '.example.com' AS virtual_host,
       CAST(NULL AS TIMESTAMP) AS access_ts
FROM events
""")
def q_parse_access_log_combined(spark, sf_dir):
    """Combined access log: user agent, session, generation time, virtual host;
    its date loses the zone, so its time stays NULL."""
    df = formats.parse_access_log(render.access_log(spark, sf_dir, combined=True))
    return df.select("file", "line_no", "format", "ip", "date", "timezone", "request_method",
                     "status", "length", "referrer", "user_agent", "session_id",
                     "generation_time_micro", "virtual_host", ntz("access_ts"))


@query("http_method_counts", f"""
SELECT {_METHOD_SQL} AS method, count(*) AS occurrences FROM events GROUP BY 1
""")
def q_http_method_counts(spark, sf_dir):
    """Request-method words over every line of the access log."""
    return formats.http_method_counts(render.access_log(spark, sf_dir, numbered=False))


@query("access_log_summary", f"""
SELECT CAST({_STATUS_SQL} AS INTEGER) AS status, {_METHOD_SQL} AS request_method,
       count(*) AS requests, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS bytes,
       min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts
FROM events GROUP BY 1, 2
""")
def q_access_log_summary(spark, sf_dir):
    """Traffic table: requests, bytes, first / last time per status and method."""
    log = formats.parse_access_log(render.access_log(spark, sf_dir, numbered=False))
    out = formats.access_log_summary(log, by=("status", "request_method"))
    return out.select("status", "request_method", "requests", "bytes",
                      ntz("first_ts"), ntz("last_ts"))


def _mixed(spark, sf_dir):
    parts = [render.access_log(spark, sf_dir), render.access_log(spark, sf_dir, combined=True),
             render.jsonl_log(spark, sf_dir), render.app_log(spark, sf_dir)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("format_profile", """
WITH files AS (
  SELECT user_id % 4 AS k, count(*) AS n FROM events GROUP BY 1)
SELECT 'access.log.' || CAST(k AS VARCHAR) AS file, 'common' AS format, n AS lines FROM files
UNION ALL SELECT 'combined.log.' || CAST(k AS VARCHAR), 'combined', n FROM files
UNION ALL SELECT 'events.jsonl.' || CAST(k AS VARCHAR), 'json', n FROM files
UNION ALL SELECT 'app.log.' || CAST(k AS VARCHAR), 'default', n + 3 FROM files
""")
def q_format_profile(spark, sf_dir):
    """Four differently formatted logs in one table: lines per file and detected format."""
    return formats.format_profile(formats.classify_lines(_mixed(spark, sf_dir)))


@query("parse_json_lines", """
SELECT event_type AS level, count(*) AS lines,
       CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
       min(date_trunc('millisecond', ts)) AS first_ts
FROM events GROUP BY 1
""")
def q_parse_json_lines(spark, sf_dir):
    """JSONL rendered from ``events``: strict JSON check, VARIANT fields, grouped."""
    df = formats.parse_json_lines(render.jsonl_log(spark, sf_dir))
    df = df.select(F.variant_get("json", "$.level", "string").alias("level"),
                   F.variant_get("json", "$.props.k", "bigint").alias("k"),
                   F.to_timestamp(F.variant_get("json", "$.ts", "string")).alias("ts"))
    return (df.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.sum("k").alias("sum_k"),
                                    F.min("ts").alias("first_ts"))
              .select("level", "lines", "sum_k", ntz("first_ts")))


@query("json_key_profile", """
SELECT key, value_type, count(*) AS lines FROM (
  SELECT 'ts' AS key, 'STRING' AS value_type FROM events
  UNION ALL SELECT 'level', 'STRING' FROM events
  UNION ALL SELECT 'props', 'OBJECT<k: BIGINT>' FROM events) t
GROUP BY 1, 2
""")
def q_json_key_profile(spark, sf_dir):
    """Top-level keys of the JSON lines, with value type and count."""
    return formats.json_key_profile(formats.parse_json_lines(render.jsonl_log(spark, sf_dir)))


@query("pretty_json", """
SELECT 'events.jsonl.' || CAST(user_id % 4 AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       '{' || chr(10) || '  "ts": "' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '",' || chr(10)
       || '  "level": "' || event_type || '",' || chr(10)
       || '  "props": {' || chr(10) || '    "k": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)
       || chr(10) || '  }' || chr(10) || '}' AS pretty
FROM events
""")
def q_pretty_json(spark, sf_dir):
    """JSON lines printed with a 2-space indent."""
    df = linefns.pretty_json(render.jsonl_log(spark, sf_dir))
    return df.select("file", "line_no", "pretty")


# ------------------------------------------------------------ timestamps (T)
@query("extract_timestamp", f"""
WITH {_APP}
SELECT file, line_no, ts, CASE WHEN ts IS NULL THEN NULL ELSE 'iso_comma_ms' END AS ts_layout
FROM app
""")
def q_extract_timestamp(spark, sf_dir):
    """Event time and layout of every line of an application log with headers."""
    return _app(spark, sf_dir).select("file", "line_no", ntz("ts"), "ts_layout")


@query("extract_timestamp_access", """
SELECT 'access.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       date_trunc('second', ts) AS ts, 'clf' AS ts_layout
FROM events
""")
def q_extract_timestamp_access(spark, sf_dir):
    """Event time found in free text of access-log lines (zoned bracket date)."""
    df = timestamps.extract_timestamp(render.access_log(spark, sf_dir))
    return df.select("file", "line_no", ntz("ts"), "ts_layout")


@query("extract_timestamp_layouts", """
SELECT 'mixed.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       CASE event_id % 8
         WHEN 0 THEN date_trunc('millisecond', ts)
         WHEN 1 THEN date_trunc('millisecond', ts)
         WHEN 2 THEN date_trunc('second', ts)
         WHEN 3 THEN date_trunc('millisecond', ts)
         WHEN 4 THEN date_trunc('second', ts)
         WHEN 5 THEN make_timestamp(1900, month(ts), day(ts), hour(ts), minute(ts),
                                    CAST(floor(second(ts)) AS DOUBLE))
         WHEN 6 THEN date_trunc('second', ts)
         ELSE ts END AS ts,
       CASE event_id % 8
         WHEN 0 THEN 'iso_comma_ms_zone' WHEN 1 THEN 'iso_dot_ms_zone' WHEN 2 THEN 'iso_s'
         WHEN 3 THEN 'isoT_comma_ms' WHEN 4 THEN 'isoT_s_zone' WHEN 5 THEN 'syslog'
         WHEN 6 THEN 'dmy_slash' ELSE 'epoch_fraction' END AS ts_layout
FROM events
""")
def q_extract_timestamp_layouts(spark, sf_dir):
    """Event times written in eight different layouts, found again in the text."""
    df = timestamps.extract_timestamp(render.mixed_layout_log(spark, sf_dir))
    return df.select("file", "line_no", ntz("ts"), "ts_layout")


@query("timestamp_profile", f"""
WITH {_APP}
SELECT file, CASE WHEN ts IS NULL THEN NULL ELSE 'iso_comma_ms' END AS ts_layout,
       count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts
FROM app GROUP BY 1, 2
""")
def q_timestamp_profile(spark, sf_dir):
    """Lines per file and layout, first and last time."""
    out = timestamps.timestamp_profile(_app(spark, sf_dir))
    return out.select("file", "ts_layout", "lines", ntz("first_ts"), ntz("last_ts"))


@query("scan_timestamps", f"""
WITH {_APP}
SELECT file, line_no, COALESCE(epoch_us(ts), 0) AS epoch_us FROM app
""")
def q_scan_timestamps(spark, sf_dir):
    """Per line (file, line_no, epoch); untimed lines give 0."""
    df = timestamps.scan_timestamps(render.app_log(spark, sf_dir))
    return df.select("file", "line_no", F.round(F.col("epoch") * 1_000_000).cast("bigint").alias("epoch_us"))


@query("lines_over_time", f"""
WITH {_APP}
SELECT file, date_trunc('hour', ts) AS period, count(*) AS lines
FROM app WHERE ts IS NOT NULL GROUP BY 1, 2
""")
def q_lines_over_time(spark, sf_dir):
    """Timed lines per hour and file."""
    return navigate.lines_over_time(_app(spark, sf_dir), "h").select("file", ntz("period"), "lines")


# ------------------------------------------------------------ merge (M)
@query("backfill_header", f"""
WITH {_APP}
SELECT file, line_no, ts_key FROM keyed
""")
def q_backfill_header(spark, sf_dir):
    """Merge time of every line: header lines take the first time of their file."""
    return merge.backfill_header(_app(spark, sf_dir)).select("file", "line_no", "ts_key")


@query("merged_positions", f"""
WITH {_APP}
SELECT file, line_no,
       CAST(row_number() OVER (ORDER BY ts_key, line_no, file_order) - 1 AS BIGINT) AS merged_no
FROM keyed
""")
def q_merged_positions(spark, sf_dir):
    """Four application logs merged by time: position of every line in the merged log."""
    df = merge.merged_positions(_app(spark, sf_dir), timed=True)
    return df.select("file", "line_no", "merged_no")


@query("merge_logs", f"""
WITH {_APP}
SELECT file_order, count(*) AS lines, min(ts_key) AS first_key, max(ts_key) AS last_key
FROM keyed GROUP BY 1
""")
def q_merge_logs(spark, sf_dir):
    """The merged log (globally sorted), summarised per source file."""
    df = merge.merge_logs(_app(spark, sf_dir), timed=True)
    return df.groupBy("file_order").agg(F.count(F.lit(1)).alias("lines"),
                                        F.min("ts_key").alias("first_key"),
                                        F.max("ts_key").alias("last_key"))


@query("find_next_merged", f"""
WITH {_APP},
merged AS (
  SELECT file, line_no, event_type,
         row_number() OVER (ORDER BY ts_key, line_no, file_order) - 1 AS merged_no
  FROM keyed)
SELECT file, line_no, CAST(merged_no AS BIGINT) AS merged_no FROM merged
WHERE event_type = 'error' AND merged_no > (SELECT count(*) FROM merged) // 2
ORDER BY merged_no LIMIT 1
""")
def q_find_next_merged(spark, sf_dir):
    """Next line holding 'error' after the middle of the merged log (top-1)."""
    df = merge.merged_positions(_app(spark, sf_dir), timed=True)
    half = df.count() // 2
    hit = search.find_next(df, "error", after=half, case_sensitive=True, position="merged_no")
    return hit.select("file", "line_no", "merged_no")


@query("find_previous_merged", f"""
WITH {_APP},
merged AS (
  SELECT file, line_no, event_type,
         row_number() OVER (ORDER BY ts_key, line_no, file_order) - 1 AS merged_no
  FROM keyed)
SELECT file, line_no, CAST(merged_no AS BIGINT) AS merged_no FROM merged
WHERE event_type = 'signup' AND merged_no < (SELECT count(*) FROM merged) // 2
ORDER BY merged_no DESC LIMIT 1
""")
def q_find_previous_merged(spark, sf_dir):
    """Previous line holding 'signup' before the middle of the merged log (top-1)."""
    df = merge.merged_positions(_app(spark, sf_dir), timed=True)
    half = df.count() // 2
    hit = search.find_previous(df, "signup", before=half, case_sensitive=True,
                               position="merged_no")
    return hit.select("file", "line_no", "merged_no")


@query("file_order", """
SELECT DISTINCT 'app.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
       CAST(user_id % 4 AS INTEGER) AS file_order FROM events
""")
def q_file_order(spark, sf_dir):
    """Natural name order of the files of a log table."""
    return render.app_log(spark, sf_dir).select("file", "file_order").distinct()


@query("file_order_documents", """
SELECT CAST(doc_id AS VARCHAR) AS file,
       CAST(dense_rank() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS file_order
FROM documents WHERE text <> ''
""")
def q_file_order_documents(spark, sf_dir):
    """Natural order of numeric names: compared as numbers, not as text."""
    docs = with_file_order(_docs(spark, sf_dir))
    return docs.select("file", "file_order").distinct()


# ------------------------------------------------------------ navigation (N)
@query("line_facts", f"""
WITH {_APP}
SELECT file, file AS file_name, ts, line_no + 1 AS line_number FROM app
""")
def q_line_facts(spark, sf_dir):
    """File name, time and 1-based number of every line."""
    return navigate.line_facts(_app(spark, sf_dir)).select(
        "file", "file_name", ntz("ts"), "line_number")


@query("time_jump_forward", f"""
WITH {_APP},
base AS (
  SELECT file, min(line_no) AS base_line FROM app
  WHERE ts IS NOT NULL AND line_no BETWEEN 0 AND 10 GROUP BY 1),
tgt AS (
  SELECT b.file, b.base_line, a.ts + INTERVAL 1 HOUR AS target_ts
  FROM base b JOIN app a ON a.file = b.file AND a.line_no = b.base_line),
hit AS (
  SELECT t.file, min(a.line_no) AS hit FROM tgt t JOIN app a ON a.file = t.file
  WHERE a.line_no > t.base_line AND a.ts >= t.target_ts GROUP BY 1),
last AS (SELECT file, max(line_no) AS last FROM app GROUP BY 1)
SELECT t.file, t.base_line, t.target_ts, COALESCE(h.hit, l.last) AS line_no
FROM tgt t JOIN last l ON l.file = t.file LEFT JOIN hit h ON h.file = t.file
""")
def q_time_jump_forward(spark, sf_dir):
    """From line 0 of every file, jump one hour forward."""
    out = navigate.time_jump(_app(spark, sf_dir), 0, 1, "h")
    return out.select("file", "base_line", ntz("target_ts"), "line_no")


@query("time_jump_backward", f"""
WITH {_APP},
base AS (
  SELECT file, min(line_no) AS base_line FROM app
  WHERE ts IS NOT NULL AND line_no BETWEEN 500 AND 510 GROUP BY 1),
tgt AS (
  SELECT b.file, b.base_line, a.ts - INTERVAL 2 DAY AS target_ts
  FROM base b JOIN app a ON a.file = b.file AND a.line_no = b.base_line),
hit AS (
  SELECT t.file, max(a.line_no) AS hit FROM tgt t JOIN app a ON a.file = t.file
  WHERE a.line_no < t.base_line AND a.line_no > 0 AND a.ts <= t.target_ts GROUP BY 1)
SELECT t.file, t.base_line, t.target_ts, COALESCE(h.hit, 0) AS line_no
FROM tgt t LEFT JOIN hit h ON h.file = t.file
""")
def q_time_jump_backward(spark, sf_dir):
    """From line 500 of every file, jump two days back."""
    out = navigate.time_jump(_app(spark, sf_dir), 500, -2, "d")
    return out.select("file", "base_line", ntz("target_ts"), "line_no")


@query("goto_line", f"""
WITH {_DOCLINES},
cnt AS (SELECT file, max(line_no) AS last FROM doclines GROUP BY 1)
SELECT d.file, d.line_no, d.line FROM doclines d JOIN cnt c ON c.file = d.file
WHERE d.line_no = greatest(0, least(9, c.last))
""")
def q_goto_line(spark, sf_dir):
    """Line 10 (1-based) of every document, clamped to its last line."""
    return navigate.goto_line(_docs(spark, sf_dir), 10).select("file", "line_no", "line")


@query("line_page", f"""
WITH {_DOCLINES}
SELECT file, line_no, line FROM doclines WHERE line_no BETWEEN 2 AND 4
""")
def q_line_page(spark, sf_dir):
    """Lines 2..4 (0-based) of every document."""
    return navigate.line_page(_docs(spark, sf_dir), 2, 3).select("file", "line_no", "line")


@query("line_page_table", f"""
WITH {_DOCLINES}
SELECT file, line_no, line FROM doclines WHERE line_no BETWEEN 10 AND 19
""")
def q_line_page_table(spark, sf_dir):
    """Lines 10..19 of every document from a parquet log table (written once,
    clustered by file and line): the line range is pruned at the scan."""
    from logweft.session import shared_dir
    from logweft.sources.sinks import read_log_table, write_log_table
    path = shared_dir(spark, "log-table")
    write_log_table(_docs(spark, sf_dir), path)
    return navigate.line_page(read_log_table(spark, path), 10, 10).select("file", "line_no", "line")


@query("head_lines", f"""
WITH {_DOCLINES}
SELECT file, line_no, line FROM doclines WHERE line_no < 2
""")
def q_head_lines(spark, sf_dir):
    """First two lines of every document."""
    return navigate.head_lines(_docs(spark, sf_dir), 2).select("file", "line_no", "line")


@query("last_lines", f"""
WITH {_DOCLINES},
cnt AS (SELECT file, max(line_no) AS last FROM doclines GROUP BY 1)
SELECT d.file, d.line_no, d.line FROM doclines d JOIN cnt c ON c.file = d.file
WHERE d.line_no > c.last - 2
""")
def q_last_lines(spark, sf_dir):
    """Last two lines of every document."""
    return navigate.last_lines(_docs(spark, sf_dir), 2).select("file", "line_no", "line")


@query("line_counts", f"""
WITH {_DOCLINES}
SELECT file, count(*) AS lines FROM doclines GROUP BY 1
""")
def q_line_counts(spark, sf_dir):
    """Lines per document."""
    return navigate.line_counts(_docs(spark, sf_dir))


@query("line_stats", f"""
WITH {_DOCLINES}
SELECT file, count(*) AS lines, max(length(line)) AS max_width,
       CAST(sum(strlen(line)) AS BIGINT) AS text_bytes
FROM doclines GROUP BY 1
""")
def q_line_stats(spark, sf_dir):
    """Per document: lines, widest line (characters), text bytes."""
    return linefns.line_stats(_docs(spark, sf_dir)).select(
        "file", "lines", F.col("max_width").cast("bigint").alias("max_width"), "text_bytes")


# ------------------------------------------------------------ lines (S7, P)
@query("logs_from_table", f"""
WITH {_DOCLINES}
SELECT file, line_no, raw, line FROM doclines
""")
def q_logs_from_table(spark, sf_dir):
    """``documents.text`` as a log: one row per line, numbered from 0."""
    return _docs(spark, sf_dir).select("file", "line_no", "raw", "line")


@query("chat_log", """
SELECT CAST(conv_id AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_no,
       trim(role || ': ' || text, chr(13) || chr(10)) AS line
FROM conversations
""")
def q_chat_log(spark, sf_dir):
    """``conversations`` as a log: one line per turn, numbered by turn order."""
    return render.chat_log(spark, sf_dir).select("file", "line_no", "line")


@query("abbreviate", f"""
WITH {_DOCLINES}
SELECT file, line_no,
       CASE WHEN length(line) > 1000 THEN left(line, 1000) || '…' ELSE line END AS short
FROM doclines
""")
def q_abbreviate(spark, sf_dir):
    """Display text of every document line: over 1,000 characters cut with an ellipsis."""
    df = linefns.abbreviate(_docs(spark, sf_dir), out="short")
    return df.select("file", "line_no", "short")


# ------------------------------------------------------------ files (S, P2, P3)
# Documents written as 8 text files: file k holds the documents with
# doc_id % 8 == k one after another in doc_id order.
_DOCFILES = """parts AS (
  SELECT doc_id, CAST(doc_id % 8 AS VARCHAR) AS file,
         string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p
  FROM documents WHERE text <> ''),
pieces AS (
  SELECT doc_id, file, i, p[i + 1] AS raw
  FROM (SELECT doc_id, file, p, unnest(range(len(p))) AS i FROM parts)),
filelines AS (
  SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY doc_id, i) - 1 AS BIGINT) AS line_no,
         raw, raw AS line
  FROM pieces)"""

_OFFSET_SQL = ("CAST(COALESCE(sum(strlen(raw) + 1) OVER (PARTITION BY file ORDER BY line_no "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)")


def _doc_files(spark, sf_dir, compression=None, offsets=False):
    folder = render.document_files(spark, sf_dir, compression)
    lines = read_logs(spark, folder, offsets=offsets).lines
    return lines.withColumn("file", render.bucket_of("file"))


@query("read_logs", f"""
WITH {_DOCFILES}
SELECT file, line_no, line FROM filelines
""")
def q_read_logs(spark, sf_dir):
    """The documents written as plain text log files, read back as a numbered log."""
    return _doc_files(spark, sf_dir).select("file", "line_no", "line")


@query("read_logs_gzip", f"""
WITH {_DOCFILES}
SELECT file, line_no, line FROM filelines
""")
def q_read_logs_gzip(spark, sf_dir):
    """The same files gzip-compressed (one split per file), read back."""
    return _doc_files(spark, sf_dir, "gzip").select("file", "line_no", "line")


@query("read_logs_bzip2", f"""
WITH {_DOCFILES}
SELECT file, line_no, line FROM filelines
""")
def q_read_logs_bzip2(spark, sf_dir):
    """The same files bzip2-compressed (splittable), read back."""
    return _doc_files(spark, sf_dir, "bzip2").select("file", "line_no", "line")


@query("byte_offsets", f"""
WITH {_DOCFILES}
SELECT file, line_no, {_OFFSET_SQL} AS byte_offset FROM filelines
""")
def q_byte_offsets(spark, sf_dir):
    """Byte position of every line of the plain log files."""
    return _doc_files(spark, sf_dir, offsets=True).select("file", "line_no", "byte_offset")


@query("file_stats", f"""
WITH {_DOCFILES}
SELECT file, count(*) AS lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS text_bytes FROM filelines GROUP BY 1
""")
def q_file_stats(spark, sf_dir):
    """Lines and text bytes of every log file."""
    return file_stats(_doc_files(spark, sf_dir)).select("file", "lines", "text_bytes")


@query("tail_logs", f"""
WITH {_DOCFILES}
SELECT file, {_OFFSET_SQL} AS byte_offset, line FROM filelines
""")
def q_tail_logs(spark, sf_dir):
    """Tail the log files from their start (streaming source, run until
    caught up): every line seen, with its byte offset."""
    from logweft.session import shared_dir
    folder = render.document_files(spark, sf_dir)
    files = [f[len("file:"):] if f.startswith("file:") else f
             for f in spark.read.text(folder).inputFiles()]
    out, ck = shared_dir(spark, "tail-out"), shared_dir(spark, "tail-ck")
    stream = tail_logs(spark, files, starting_position="earliest")
    q = (stream.writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    return got.select(render.bucket_of("file").alias("file"), "byte_offset", "line")


# ------------------------------------------------------------ streams (W)
def _run_stream(spark, df, complete=False):
    """Run a streaming query until it has caught up; return what it wrote.

    Append queries write parquet files; complete-mode aggregates replace a
    parquet table on every batch, so the last batch holds the final state.
    """
    from logweft.session import shared_dir
    out, ck = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ck")
    w = df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if complete:
        w = w.outputMode("complete").foreachBatch(
            lambda batch, _epoch: batch.write.mode("overwrite").parquet(out))
    else:
        w = w.format("parquet").option("path", out)
    w.start().awaitTermination()
    return spark.read.parquet(out)


@query("search_stream", f"""
WITH {_DOCFILES}
SELECT file, line FROM filelines WHERE contains(line, 'token')
""")
def q_search_stream(spark, sf_dir):
    """Lines holding 'token' in log files landing in a folder (file stream)."""
    folder = render.document_files(spark, sf_dir)
    found = search_stream(stream_log_dir(spark, folder, max_files_per_trigger=2), "token",
                          case_sensitive=True)
    got = _run_stream(spark, found.select("file", "line"))
    return got.select(render.bucket_of("file").alias("file"), "line")


@query("pending_lines", f"""
WITH {_DOCFILES}
SELECT file, count(*) AS pending_lines FROM filelines GROUP BY 1
""")
def q_pending_lines(spark, sf_dir):
    """Running count of unseen lines per file over a file stream (complete mode)."""
    folder = render.document_files(spark, sf_dir)
    counts = pending_lines(stream_log_dir(spark, folder, max_files_per_trigger=3))
    got = _run_stream(spark, counts, complete=True)
    return got.select(render.bucket_of("file").alias("file"), "pending_lines")


@query("lines_over_time_stream", """
SELECT date_trunc('hour', ts) AS period, 'app.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
       count(*) AS lines
FROM events GROUP BY 1, 2
""")
def q_lines_over_time_stream(spark, sf_dir):
    """Hourly lines per file of a streamed application log: event times
    parsed from the text, watermarked windowed counts."""
    folder = render.app_log_files(spark, sf_dir)
    stream = stream_log_dir(spark, folder, max_files_per_trigger=1)
    stream = stream.withColumn("file", render.app_file_of("file"))
    counts = lines_over_time_stream(stream, "1 hour", "1 day")
    got = _run_stream(spark, counts, complete=True)
    return got.select(ntz("period"), "file", "lines")


# ------------------------------------------------------------ search (Q)
@query("search_literal", f"""
WITH {_DOCLINES}
SELECT file, line_no FROM doclines WHERE contains(line, 'token')
""")
def q_search_literal(spark, sf_dir):
    """Lines holding 'token' (case-sensitive)."""
    return search.search_literal(_docs(spark, sf_dir), "token").select("file", "line_no")


@query("search_ignore_case", f"""
WITH {_DOCLINES}
SELECT file, line_no FROM doclines WHERE contains(lower(line), 'the')
""")
def q_search_ignore_case(spark, sf_dir):
    """Lines holding 'THE' in any case."""
    return search.search_ignore_case(_docs(spark, sf_dir), "THE").select("file", "line_no")


@query("search_regex", f"""
WITH {_DOCLINES}
SELECT file, line_no FROM doclines
WHERE regexp_matches(line, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')
""")
def q_search_regex(spark, sf_dir):
    """Lines matching an IPv4-like regex."""
    out = search.search_regex(_docs(spark, sf_dir), r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
                              case_sensitive=True)
    return out.select("file", "line_no")


@query("search_regex_ignore_case", f"""
WITH {_DOCLINES}
SELECT file, line_no FROM doclines WHERE regexp_matches(line, 'the [a-z]+ of', 'i')
""")
def q_search_regex_ignore_case(spark, sf_dir):
    """Lines matching 'the <word> of' in any case."""
    out = search.search_regex(_docs(spark, sf_dir), "the [a-z]+ of")
    return out.select("file", "line_no")


@query("match_spans", f"""
WITH {_DOCLINES}
SELECT file, line_no, CAST(len(string_split(line, 'de')) - 1 AS INTEGER) AS match_count,
       CAST(strpos(line, 'de') - 1 AS INTEGER) AS first_start,
       CAST(length(line) - strpos(reverse(line), 'ed') + 1 AS INTEGER) AS last_end
FROM doclines WHERE contains(line, 'de')
""")
def q_match_spans(spark, sf_dir):
    """Every 'de' in every line: count, first start and last end of the spans."""
    df = search.match_spans(_docs(spark, sf_dir), "de", case_sensitive=True)
    return (df.filter(F.col("match_count") > 0)
              .select("file", "line_no", "match_count",
                      F.element_at("spans", 1).start.alias("first_start"),
                      F.element_at("spans", -1).end.alias("last_end")))


@query("find_next", f"""
WITH {_DOCLINES}
SELECT file, min(line_no) AS hit_line_no FROM doclines
WHERE contains(lower(line), 'the') AND line_no > 2 GROUP BY 1
""")
def q_find_next(spark, sf_dir):
    """In every document, the next line holding 'the' after line 2."""
    return search.next_hits(_docs(spark, sf_dir), "the", after=2)      # in every file at once; find_next_merged asks one log


@query("find_previous", f"""
WITH {_DOCLINES}
SELECT file, max(line_no) AS hit_line_no FROM doclines
WHERE contains(lower(line), 'the') AND line_no < 5 GROUP BY 1
""")
def q_find_previous(spark, sf_dir):
    """In every document, the previous line holding 'the' before line 5."""
    return search.next_hits(_docs(spark, sf_dir), "the", after=5, direction="previous")


@query("search_summary", f"""
WITH {_DOCLINES}
SELECT file, count(*) AS hits, min(line_no) AS first_hit, max(line_no) AS last_hit
FROM doclines WHERE contains(line, '@') GROUP BY 1
""")
def q_search_summary(spark, sf_dir):
    """Hits of '@' per document: count, first and last line."""
    return search.search_summary(_docs(spark, sf_dir), "@", case_sensitive=True)


@query("token_counts", f"""
WITH {_DOCLINES}
SELECT token, count(*) AS occurrences FROM (
  SELECT unnest(regexp_split_to_array(line, '[\\s/\\[\\]\\(\\)"]')) AS token FROM doclines) t
WHERE length(token) > 1 GROUP BY 1
""")
def q_token_counts(spark, sf_dir):
    """Vocabulary of all document lines: words longer than one character."""
    return search.token_counts(_docs(spark, sf_dir))


@query("suggest_words", f"""
WITH {_DOCLINES},
words AS (
  SELECT DISTINCT token AS word FROM (
    SELECT unnest(regexp_split_to_array(line, '[\\s/\\[\\]\\(\\)"]')) AS token FROM doclines) t
  WHERE length(token) >= 3),
prefixes AS (
  SELECT word, unnest(range(1, length(word) - 1)) AS n FROM words)
SELECT lower(substr(word, 1, n)) AS prefix,
       first(word ORDER BY length(word) DESC, word DESC) AS word
FROM prefixes GROUP BY 1
""")
def q_suggest_words(spark, sf_dir):
    """Completion index of the documents: prefix -> longest word."""
    return search.suggest_words(_docs(spark, sf_dir))


@query("complete_words", f"""
WITH {_DOCLINES},
words AS (
  SELECT DISTINCT token AS word FROM (
    SELECT unnest(regexp_split_to_array(line, '[\\s/\\[\\]\\(\\)"]')) AS token FROM doclines) t
  WHERE length(token) >= 3),
prefixes AS (SELECT word, unnest(range(1, length(word) - 1)) AS n FROM words),
idx AS (
  SELECT lower(substr(word, 1, n)) AS prefix,
         first(word ORDER BY length(word) DESC, word DESC) AS word
  FROM prefixes GROUP BY 1),
typed AS (
  SELECT file, line_no, line AS typed,
         regexp_extract(line, '[^\\s/\\[\\]\\(\\)"]*$', 0) AS last
  FROM doclines)
SELECT t.file, t.line_no, t.typed,
       CASE WHEN i.word IS NULL THEN NULL
            ELSE substr(t.typed, 1, length(t.typed) - length(t.last)) || i.word END AS suggestion
FROM typed t LEFT JOIN idx i ON lower(t.last) = i.prefix AND t.last <> ''
""")
def q_complete_words(spark, sf_dir):
    """Complete the last word of every line from the documents' own
    completion index."""
    docs = _docs(spark, sf_dir)
    typed = docs.select("file", "line_no", F.col("line").alias("typed"))
    index = search.suggest_words(docs, lengths=search.typed_lengths(typed))
    return search.complete_all(index, typed).select("file", "line_no", "typed", "suggestion")


# ------------------------------------------------------------ entities (E)
# One entity of each kind per event, in the order they stand in the line.
_ENTITIES = """elines AS (
  SELECT 'entity.log.' || CAST(user_id % 4 AS VARCHAR) AS file,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS line_no, *
  FROM events),
each AS (
  SELECT file, line_no, unnest([
    {'p': 0, 'kind': 'ipv4', 'value': '10.1.' || (user_id % 256) || '.' || (event_id % 256)},
    {'p': 1, 'kind': 'ipv6', 'value': 'fe80::' || format('{:04x}', event_id % 65536)},
    {'p': 2, 'kind': 'eui64', 'value': '02-00-5e-10-00-00-00-' || format('{:02x}', event_id % 256)},
    {'p': 3, 'kind': 'eui48', 'value': '02-00-5e-10-01-' || format('{:02x}', user_id % 256)},
    {'p': 4, 'kind': 'uuid', 'value': format('{:08x}', event_id) || '-0000-4000-8000-' || format('{:012x}', user_id)},
    {'p': 5, 'kind': CASE WHEN event_id % 2 = 0 THEN 'bool_true' ELSE 'bool_false' END,
     'value': CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END},
    {'p': 6, 'kind': 'none', 'value': 'None'},
    {'p': 7, 'kind': 'number', 'value': CASE WHEN event_id % 3 = 0 THEN '-' || event_id END},
    {'p': 8, 'kind': 'str', 'value': chr(39) || event_type || chr(39)},
    {'p': 9, 'kind': 'path', 'value': '[/v1/' || event_type || '/' || user_id || ']'}]) AS x
  FROM elines),
ents AS (
  SELECT file, line_no, CAST(row_number() OVER (PARTITION BY file, line_no ORDER BY x.p) - 1 AS INTEGER) AS pos,
         x.kind AS kind, x.value AS value
  FROM each WHERE x.value IS NOT NULL)"""


@query("extract_entities", f"""
WITH {_ENTITIES}
SELECT file, line_no, pos, kind, value FROM ents
""")
def q_extract_entities(spark, sf_dir):
    """Entity table (file, line, position, kind, value) of lines with an entity of each kind."""
    return entities.extract_entities(render.entity_log(spark, sf_dir))


@query("entity_counts", f"""
WITH {_ENTITIES}
SELECT kind, count(*) AS matches, count(DISTINCT value) AS distinct_values FROM ents GROUP BY 1
""")
def q_entity_counts(spark, sf_dir):
    """Matches and distinct values per entity kind."""
    return entities.entity_counts(entities.extract_entities(render.entity_log(spark, sf_dir)))


@query("top_entities", f"""
WITH {_ENTITIES},
counted AS (SELECT kind, value, count(*) AS occurrences FROM ents GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY occurrences DESC, value) AS INTEGER) AS rank
           FROM counted)
SELECT kind, value, occurrences, rank FROM ranked WHERE rank <= 10
""")
def q_top_entities(spark, sf_dir):
    """The ten most frequent values of every entity kind."""
    return entities.top_entities(entities.extract_entities(render.entity_log(spark, sf_dir)), k=10)


@query("document_entities", None)
def q_document_entities(spark, sf_dir):
    """Entity table of every document line, whole lines (checked against Python in the tests)."""
    return entities.extract_entities(_docs(spark, sf_dir))


@query("document_entity_counts", None)
def q_document_entity_counts(spark, sf_dir):
    """Matches and distinct values per entity kind over every document line (checked against Python in the tests)."""
    return entities.entity_counts(entities.extract_entities(_docs(spark, sf_dir)))


@query("document_top_entities", None)
def q_document_top_entities(spark, sf_dir):
    """The ten most frequent values of every entity kind over every document line (checked against Python in the tests)."""
    return entities.top_entities(entities.extract_entities(_docs(spark, sf_dir)), k=10)


# ------------------------------------------------------------ long lines, user formats
@query("long_access_lines", f"""
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line_no, 'common' AS format,
       {_STATUS_SQL} AS status, event_id AS length, CAST(12009 AS INTEGER) AS referrer_chars,
       'agent/' || user_id AS user_agent_clean, date_trunc('second', ts) AS access_ts
FROM events
""")
def q_long_access_lines(spark, sf_dir):
    """Access lines of over 12,000 characters parse whole."""
    events = render.load(spark, sf_dir, "events").withColumn("file", F.lit("long.log"))
    log = logs_from_table(events, render.long_text(events), "file", order_col="event_id")       # numbered, then written
    out = formats.parse_access_log(log)
    return out.select("line_no", "format", "status", "length",
                      F.length("referrer_clean").alias("referrer_chars"), "user_agent_clean", ntz("access_ts"))


@query("user_format_and_layout", """
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line_no, 'queue' AS format,
       CAST(user_id AS VARCHAR) AS worker, event_type AS job, date_trunc('second', ts) AS ts,
       'dots' AS ts_layout
FROM events
""")
def q_user_format_and_layout(spark, sf_dir):
    """A user's own line format (new group names) and time layout, passed as arguments."""
    events = render.load(spark, sf_dir, "events")
    ts = F.date_format(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "dd.MM.yyyy HH.mm.ss")
    lines = events.select(F.lit("queue.log").alias("file"), "event_id", F.concat(
        ts, F.lit(" worker<"), F.col("user_id").cast("string"), F.lit("> "), F.col("event_type")).alias("text"))
    log = logs_from_table(lines, "text", "file", order_col="event_id")
    own = formats.LineFormat("queue", r"\S+ \S+ worker<(\d+)> (\w+)", ("worker", "job"))
    dots = timestamps.strptime_layout("dots", r"\d{2}\.\d{2}\.\d{4} \d{2}\.\d{2}\.\d{2}", "dd.MM.yyyy HH.mm.ss")
    out = timestamps.extract_timestamp(log, layouts=[*timestamps.LAYOUT_NAMES, dots])
    out = formats.parse_access_log(out, formats=[*formats.LINE_FORMATS, own])
    return out.select("line_no", "format", "worker", "job", ntz("ts"), "ts_layout")


@query("extract_timestamp_zones", """
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       CASE event_id % 7 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('millisecond', ts) WHEN 3 THEN date_trunc('millisecond', ts)
         WHEN 4 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS ts,
       CASE event_id % 7 WHEN 0 THEN 'iso_dot_ms' WHEN 1 THEN 'iso_s_zone' WHEN 2 THEN 'isoT_comma_ms_zone'
         WHEN 3 THEN 'isoT_dot_ms_zone' WHEN 4 THEN 'isoT_dot_ms' WHEN 5 THEN 'isoT_s' ELSE 'epoch13' END AS ts_layout
FROM events
""")
def q_extract_timestamp_zones(spark, sf_dir):
    """The seven further layouts, found again in the text."""
    lines = render.zone_layout_lines(render.load(spark, sf_dir, "events"))
    log = logs_from_table(lines, "text", "file", order_col="event_id")
    return timestamps.extract_timestamp(log).select("line_no", ntz("ts"), "ts_layout")


# ------------------------------------------------------------ merged log (K, M6)
_MERGED = _APP + """,
merged AS (
  SELECT file, line_no, ts, CAST(row_number() OVER (ORDER BY ts_key, line_no, file_order) - 1 AS BIGINT) AS merged_no
  FROM keyed)"""


def _merged(spark, sf_dir):
    return merge.merged_positions(_app(spark, sf_dir), timed=True)


@query("save_merged", f"""
WITH {_MERGED},
text AS (
  SELECT m.merged_no, CASE WHEN b.event_type IS NULL
           THEN '# header ' || (m.line_no + 1) || ' of ' || m.file
           ELSE strftime(b.ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(epoch_ms(b.ts) % 1000 AS VARCHAR), 3, '0')
                || ' ' || b.event_type || ' user=' || b.user_id END AS line
  FROM merged m JOIN (SELECT k.*, e.user_id FROM keyed k LEFT JOIN (
         SELECT 'app.log.' || CAST(user_id % 4 AS VARCHAR) AS file, user_id,
                CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) + 2 AS BIGINT) AS line_no
         FROM events) e ON e.file = k.file AND e.line_no = k.line_no) b
    ON b.file = m.file AND b.line_no = m.line_no)
SELECT merged_no, line FROM text
""")
def q_save_merged(spark, sf_dir):
    """The merged log saved as text and read back: part files in name order give the merged order."""
    from logweft.session import shared_dir
    path = shared_dir(spark, "merged-log")
    merge.save_merged(_app(spark, sf_dir), path, timed=True, count=False)
    back = read_logs(spark, path).lines
    before = Window.orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)
    first = back.groupBy("file_order").agg(F.count(F.lit(1)).alias("n")) \
                .select("file_order", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return back.join(first, "file_order").select((F.col("first") + F.col("line_no")).alias("merged_no"), "line")


@query("merge_logs_order", f"""
WITH {_MERGED}
SELECT merged_no AS place, file, line_no FROM merged
""")
def q_merge_logs_order(spark, sf_dir):
    """The sorted log's own order: each row's place in the sorted output."""
    out = merge.merge_logs(_app(spark, sf_dir), timed=True).select("file", "line_no")
    from logweft.session import shared_dir
    path = shared_dir(spark, "sorted-log")
    out.write.parquet(path)     # part files hold the sorted partitions in order
    back = spark.read.parquet(path)
    rows = back.select("file", "line_no", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"),
                       F.col("_metadata.row_index").alias("row"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")) \
                .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(first, "part").select((F.col("first") + F.col("row")).alias("place"), "file", "line_no")


@query("goto_line_merged", f"""
WITH {_MERGED} SELECT file, line_no, merged_no FROM merged WHERE merged_no = 99
""")
def q_goto_line_merged(spark, sf_dir):
    """Line 100 of the merged log."""
    return navigate.goto_line(_merged(spark, sf_dir), 100, by=(), position="merged_no").select(
        "file", "line_no", "merged_no")


@query("line_page_merged", f"""
WITH {_MERGED} SELECT file, line_no, merged_no FROM merged WHERE merged_no BETWEEN 50 AND 74
""")
def q_line_page_merged(spark, sf_dir):
    """Lines 50..74 of the merged log."""
    return navigate.line_page(_merged(spark, sf_dir), 50, 25, position="merged_no").select(
        "file", "line_no", "merged_no")


@query("last_lines_merged", f"""
WITH {_MERGED} SELECT file, line_no, merged_no FROM merged
WHERE merged_no > (SELECT max(merged_no) FROM merged) - 5
""")
def q_last_lines_merged(spark, sf_dir):
    """The last five lines of the merged log."""
    return navigate.last_lines(_merged(spark, sf_dir), 5, by=(), position="merged_no").select(
        "file", "line_no", "merged_no")


@query("time_jump_merged", f"""
WITH {_MERGED},
base AS (SELECT merged_no, ts + INTERVAL 1 DAY AS target_ts FROM merged
         WHERE ts IS NOT NULL AND merged_no BETWEEN 200 AND 210 ORDER BY merged_no LIMIT 1)
SELECT b.merged_no AS base_line, b.target_ts,
       coalesce((SELECT min(m.merged_no) FROM merged m, base b WHERE m.merged_no > b.merged_no AND m.ts >= b.target_ts),
                (SELECT max(merged_no) FROM merged)) AS merged_no
FROM base b
""")
def q_time_jump_merged(spark, sf_dir):
    """From line 200 of the merged log, jump one day forward."""
    out = navigate.time_jump(_merged(spark, sf_dir), 200, 1, "d", by=(), position="merged_no")
    return out.select("base_line", ntz("target_ts"), "merged_no")


# ------------------------------------------------------------ sources and streams
@query("missing_files", f"""
WITH {_DOCFILES}
SELECT 'read' AS state, count(*) AS n FROM filelines UNION ALL SELECT 'missing', 1
""")
def q_missing_files(spark, sf_dir):
    """A missing path is reported while the others are read."""
    folder = render.document_files(spark, sf_dir)
    found = read_logs(spark, [folder, folder + "/no-such.log"], on_missing="report")
    read = found.lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("read").alias("state"), "n")
    return read.unionByName(found.errors.agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("state"), "n"))


@query("parse_stream", f"""
SELECT {_STATUS_SQL} AS status, 'common' AS format, date_trunc('second', ts) AS access_ts,
       'agent/' || user_id AS user_agent_clean
FROM events
""")
def q_parse_stream(spark, sf_dir):
    """Access lines landing in a folder, classified and parsed as a stream."""
    from logweft.session import shared_dir
    folder = shared_dir(spark, "access-files")
    render.access_lines(render.load(spark, sf_dir, "events")).repartition(4).select("text").write.text(folder)
    out = parse_stream(stream_log_dir(spark, folder, max_files_per_trigger=2))
    got = _run_stream(spark, out.select("status", "format", "access_ts", "user_agent_clean"))
    return got.select("status", "format", ntz("access_ts"), "user_agent_clean")


@query("lines_over_time_append", """
WITH t AS (SELECT date_trunc('hour', ts) AS period, count(*) AS lines FROM events GROUP BY 1)
SELECT period, 'app.log' AS file, lines FROM t
WHERE period + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
""")
def q_lines_over_time_append(spark, sf_dir):
    """Hourly lines in append mode: windows that the watermark has closed, each written once."""
    from logweft.session import shared_dir
    folder = shared_dir(spark, "append-files")
    events = render.load(spark, sf_dir, "events")
    # all files are there before the run and it takes them in one trigger, so no line comes later than the watermark
    # allows, whatever task wrote it
    render.app_lines(events).filter(~F.col("text").startswith("#")).select("text").write.text(folder)
    stream = stream_log_dir(spark, folder).withColumn("file", F.lit("app.log"))
    got = _run_stream(spark, lines_over_time_stream(stream, "1 hour", "1 day"))
    return got.select(ntz("period"), "file", "lines")


# ------------------------------------------------------------ raw files by position
def _index(spark, folder, every, timed=False):
    """An index of a folder's files, kept as a table and read back."""
    from logweft.session import shared_dir
    path = shared_dir(spark, "line-index")
    line_index.write_index(line_index.line_index(spark, folder, every, timed), path)
    return spark.read.parquet(path)


@query("line_page_indexed", f"""
WITH {_DOCFILES}
SELECT file, line_no, {_OFFSET_SQL} AS byte_offset, line FROM filelines
QUALIFY line_no BETWEEN 40 AND 59
""")
def q_line_page_indexed(spark, sf_dir):
    """Lines 40..59 of every text log file, read by position through a sparse line index."""
    index = _index(spark, render.document_files(spark, sf_dir), 16)
    page = line_index.page_by_index(spark, index, 40, 20)
    return page.withColumn("file", render.bucket_of("file")).select("file", "line_no", "byte_offset", "line")


@query("goto_line_indexed", f"""
WITH {_DOCFILES},
cnt AS (SELECT file, max(line_no) AS last FROM filelines GROUP BY 1)
SELECT d.file, d.line_no, d.line FROM filelines d JOIN cnt c ON c.file = d.file
WHERE d.line_no = greatest(0, least(199, c.last))
""")
def q_goto_line_indexed(spark, sf_dir):
    """Line 200 (1-based) of every text log file, clamped to its last line, through a sparse line index."""
    index = _index(spark, render.document_files(spark, sf_dir), 64)
    hit = line_index.goto_by_index(spark, index, 200)
    return hit.withColumn("file", render.bucket_of("file")).select("file", "line_no", "line")


def _jump_indexed(spark, sf_dir, *jump):
    index = _index(spark, render.app_log_files(spark, sf_dir), 100, timed=True)
    out = line_index.time_jump_by_index(spark, index, *jump)
    return out.withColumn("file", render.app_file_of("file")).select("file", "base_line", ntz("target_ts"), "line_no")


@query("time_jump_forward_indexed", REGISTRY["time_jump_forward"].oracle)
def q_time_jump_forward_indexed(spark, sf_dir):
    """From line 0 of every text log file one hour forward, through an index with times."""
    return _jump_indexed(spark, sf_dir, 0, 1, "h")


@query("time_jump_backward_indexed", REGISTRY["time_jump_backward"].oracle)
def q_time_jump_backward_indexed(spark, sf_dir):
    """From line 500 of every text log file two days back, through an index with times."""
    return _jump_indexed(spark, sf_dir, 500, -2, "d")


@query("byte_offsets_gzip", REGISTRY["byte_offsets"].oracle)
def q_byte_offsets_gzip(spark, sf_dir):
    """Position of every line in the text of gzip files."""
    return _doc_files(spark, sf_dir, "gzip", offsets=True).select("file", "line_no", "byte_offset")


@query("broken_files", f"""
WITH {_DOCFILES},
good AS (SELECT file, count(*) AS lines FROM filelines GROUP BY 1)
SELECT file, lines, CAST(NULL AS VARCHAR) AS error FROM good
UNION ALL
SELECT 'cut-' || file, lines, 'the file ends inside a gzip member' FROM good
""")
def q_broken_files(spark, sf_dir):
    """Gzip files and copies of them that break off in a second member: all lines before the break are read and every
    broken file is named."""
    folder = render.document_files(spark, sf_dir, "gzip")
    name = lambda c: F.concat(F.when(F.col(c).contains("/cut"), "cut-").otherwise(""), render.bucket_of(c))
    render.cut_copies(spark, folder)
    found = read_logs(spark, folder, on_missing="report")
    lines = found.lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    errors = found.errors.select(F.col("path").alias("file"), "error")
    return lines.join(errors, "file", "left").select(name("file").alias("file"), "lines", "error")


# ------------------------------------------------------------ lines of any length
@query("long_line_entities", f"""
WITH {_ENTITIES},
width AS (SELECT CAST(sum(length('x' || event_type) + 4 - length('x' || event_type) % 4) AS BIGINT) AS n FROM events)
SELECT kind, count(*) AS matches, count(DISTINCT value) AS distinct_values, any_value(width.n) AS tab_width
FROM ents, width GROUP BY kind
""")
def q_long_line_entities(spark, sf_dir):
    """Entities of logs of four lines, as long as the table, each followed by a line of characters and tabs of the same
    length: tabs and entities in time that grows with the line."""
    events = render.load(spark, sf_dir, "events")
    lines = logs_from_table(render.joined_lines(render.entity_lines(events), " ~ "), "text", "file", part_col="part")
    tabs = logs_from_table(render.joined_lines(events.select(
        F.lit("tabs.log").alias("file"), "event_id", F.concat(F.lit("x"), "event_type").alias("text")), "\t", last="\t"), "text", "file",
        part_col="part")
    width = tabs.agg(F.sum(F.length("line")).alias("tab_width"))
    return entities.entity_counts(entities.extract_entities(lines, piece_col="piece")).crossJoin(width)       # one row


# ------------------------------------------------------------ files that grow
_GROWN = f"""{_DOCFILES},
sizes AS (SELECT file, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes FROM filelines GROUP BY 1),
offsets AS (SELECT file, {_OFFSET_SQL} AS byte_offset, line FROM filelines),
added AS (
  SELECT CAST(CAST(o.file AS INTEGER) - 4 AS VARCHAR) AS file, o.byte_offset + s.bytes AS byte_offset, line
  FROM offsets o JOIN sizes s ON CAST(s.file AS INTEGER) = CAST(o.file AS INTEGER) - 4)"""


def _growing(spark, sf_dir):
    """Four growing files and what is written to them later (files 4..7)."""
    folder = render.document_files(spark, sf_dir)
    files = {f.split("bucket=")[1].split("/")[0]: f for f in spark.read.text(folder).inputFiles()}
    # the driver's paths: a folder of its own for each file, so none is missing
    growing = [files[k] for k in "0123"]
    return [re.sub("^file:/+", "/", f) for f in growing], [(files[str(k + 4)], files[str(k)]) for k in range(4)]


def _tail_twice(spark, sf_dir, position):
    """Lines that two runs on one checkpoint read, before and after the files have grown."""
    from logweft.session import shared_dir
    paths, later = _growing(spark, sf_dir)
    out, ck = shared_dir(spark, "tail-out"), shared_dir(spark, "tail-ck")
    for k in range(2):
        stream = tail_logs(spark, paths, starting_position=position)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
              .trigger(availableNow=True).start().awaitTermination()
        if k == 0:
            render.append_files(spark, later)
    return spark.read.parquet(out).select(render.bucket_of("file").alias("file"), "byte_offset", "line")


@query("tail_latest", f"""
WITH {_GROWN}
SELECT file, byte_offset, line FROM added
""")
def q_tail_latest(spark, sf_dir):
    """A tail from the latest position: only lines written after it began."""
    return _tail_twice(spark, sf_dir, "latest")


@query("tail_resumed", f"""
WITH {_GROWN}
SELECT file, byte_offset, line FROM added
UNION ALL SELECT file, byte_offset, line FROM offsets WHERE CAST(file AS INTEGER) < 4
""")
def q_tail_resumed(spark, sf_dir):
    """A tail that pauses while the files grow and goes on at its stored offsets: every line once."""
    return _tail_twice(spark, sf_dir, "earliest")


@query("tail_drained", f"""
WITH {_DOCFILES},
offsets AS (SELECT file, {_OFFSET_SQL} AS byte_offset, line FROM filelines)
SELECT file, byte_offset, line, true AS several FROM offsets WHERE CAST(file AS INTEGER) < 4
""")
def q_tail_drained(spark, sf_dir):
    """What the files hold at the start, read in a series of batches of a third of the largest file."""
    import os
    from logweft.session import shared_dir
    paths, _ = _growing(spark, sf_dir)
    cap = max(1, max(os.path.getsize(p) for p in paths) // 3)
    out = shared_dir(spark, "tail-out")
    n = drain(spark, paths, shared_dir(spark, "tail-ck"), lambda df: df.writeStream.format("parquet").option("path", out), cap, "earliest")
    return spark.read.parquet(out).select(render.bucket_of("file").alias("file"), "byte_offset", "line", F.lit(n >= 3).alias("several"))


@query("tail_errors", f"""
WITH {_DOCFILES}
SELECT 'line' AS state, count(*) AS n FROM filelines WHERE CAST(file AS INTEGER) < 4 UNION ALL SELECT 'cannot read file', 1
""")
def q_tail_errors(spark, sf_dir):
    """A path that cannot be read is reported once while the others are followed."""
    paths, _ = _growing(spark, sf_dir)
    got = _run_stream(spark, tail_logs(spark, [*paths, paths[0] + ".none"], starting_position="earliest").select("line", "error"))
    return got.groupBy(F.coalesce("error", F.lit("line")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ line projections and search forms
_ODD = """odd AS (
  SELECT 'odd.log' AS file, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line_no, * FROM events)"""


def _odd_log(spark, sf_dir):
    """Lines with tabs, colour codes, bytes that are no UTF-8, folded breaks and line ends, as a writer left them."""
    return logs_from_table(render.odd_lines(render.load(spark, sf_dir, "events")), "text", "file", order_col="event_id")


@query("normalize_lines", f"""
WITH {_ODD}
SELECT line_no, event_type || repeat(' ', CAST(4 - length(event_type) % 4 AS INTEGER)) || user_id || chr(27) || '[31mred' || chr(27)
       || '[0m' || chr(65533) || '\\n' || event_id AS line
FROM odd
""")
def q_normalize_lines(spark, sf_dir):
    """Lenient decoding, line ends and tabs of odd lines."""
    return _odd_log(spark, sf_dir).select("line_no", "line")


@query("strip_ansi_unfold", f"""
WITH {_ODD}
SELECT line_no, event_type || repeat(' ', CAST(4 - length(event_type) % 4 AS INTEGER)) || user_id || 'red' || chr(65533) || chr(10)
       || event_id AS detail
FROM odd
""")
def q_strip_ansi_unfold(spark, sf_dir):
    """Colour codes dropped and folded breaks opened."""
    plain = linefns.strip_ansi(_odd_log(spark, sf_dir))
    return linefns.detail_text(plain).select("line_no", "detail")


@query("search_forms", f"""
WITH {_DOCLINES}
SELECT 'literal' AS form, count(*) AS hits FROM doclines WHERE contains(line, '.')
UNION ALL SELECT 'any case', count(*) FROM doclines WHERE contains(lower(line), 'de')
UNION ALL SELECT 'regex, any case', count(*) FROM doclines WHERE regexp_matches(line, '(DE|the) [a-f]', 'i')
UNION ALL SELECT 'regex', count(*) FROM doclines WHERE regexp_matches(line, '^[A-Z]')
""")
def q_search_forms(spark, sf_dir):
    """One search object in its forms: a literal dot, any case, the empty text and a pattern."""
    forms = {"literal": search.Search(".", False, True), "any case": search.Search("DE", False, False),
             "regex": search.Search("^[A-Z]", True, True), "regex, any case": search.Search("(DE|the) [a-f]", True, False)}
    log = _docs(spark, sf_dir)
    hits = log.agg(*[F.count_if(s.matches("line")).alias(k) for k, s in forms.items()])      # one pass
    return hits.select(F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.col(f"`{k}`").alias("hits")) for k in forms])).alias("x")) \
               .select("x.form", "x.hits")


@query("pending_after_seen", f"""
WITH {_DOCFILES},
sizes AS (SELECT file, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes FROM filelines GROUP BY 1),
offsets AS (SELECT file, {_OFFSET_SQL} AS byte_offset FROM filelines)
SELECT file, count(*) FILTER (byte_offset >= bytes * 2 // 3) AS pending_lines, bytes * 2 // 3 AS seen
FROM offsets JOIN sizes USING (file) WHERE CAST(file AS INTEGER) < 4 GROUP BY file, bytes
""")
def q_pending_after_seen(spark, sf_dir):
    """Lines past the seen position, which two control events move while the files are followed."""
    import os
    from logweft.session import shared_dir
    from logweft.streaming.seen import pending_after_seen
    paths, _ = _growing(spark, sf_dir)
    control, out, ck = (shared_dir(spark, x) for x in ("control", "seen-out", "seen-ck"))
    sizes = spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "file string, size long")      # four rows
    for thirds in (1, 2):
        sizes.select("file", F.expr(f"size * {thirds} div 3").alias("seen")).write.mode("append").json(control)
        lines = tail_logs(spark, paths, starting_position="earliest")
        events = spark.readStream.schema("file string, seen long").json(control)
        pending_after_seen(lines, events).writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(
            lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        ).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("file").agg(F.max_by(F.struct("pending_lines", "seen"), "batch").alias("x"))
    return last.select(render.bucket_of("file").alias("file"), "x.pending_lines", "x.seen")
