"""Timestamp layouts: one line per layout (FIXTURES §2) and a Python model."""

import datetime as dt
import random
import re
import warnings

warnings.filterwarnings("ignore", category=DeprecationWarning)

import pytest

from log_lines_helper import lines_df
from logweft.functions.timestamps import extract_timestamp, parse_timestamp_value

D = dt.datetime

CASES = [
    ("2024-01-08 13:31:48,123Z up", D(2024, 1, 8, 13, 31, 48, 123000), "iso_comma_ms_zone"),
    ("2024-01-08 13:31:48,123-0500 up", D(2024, 1, 8, 18, 31, 48, 123000), "iso_comma_ms_zone"),
    ("2024-01-08 13:31:48,123 up", D(2024, 1, 8, 13, 31, 48, 123000), "iso_comma_ms"),
    ("2024-01-08 13:31:48.123-0500 up", D(2024, 1, 8, 18, 31, 48, 123000), "iso_dot_ms_zone"),
    ("2024-01-08 13:31:48.123 -0500 up", D(2024, 1, 8, 13, 31, 48, 123000), "iso_dot_ms"),
    ("2024-01-08 13:31:48.123456 up", D(2024, 1, 8, 13, 31, 48, 123000), "iso_dot_ms"),
    ("2024-01-08 13:31:48-0500 up", D(2024, 1, 8, 18, 31, 48), "iso_s_zone"),
    ("2024-01-08 13:31:48 -0500 up", D(2024, 1, 8, 18, 31, 48), "iso_s_zone"),
    ("2024-01-08 13:31:48 up", D(2024, 1, 8, 13, 31, 48), "iso_s"),
    ("2024-01-08T13:31:48,123Z up", D(2024, 1, 8, 13, 31, 48, 123000), "isoT_comma_ms_zone"),
    ("2024-01-08T13:31:48,123 up", D(2024, 1, 8, 13, 31, 48, 123000), "isoT_comma_ms"),
    ("2024-01-08T13:31:48.123Z up", D(2024, 1, 8, 13, 31, 48, 123000), "isoT_dot_ms_zone"),
    ("2024-01-08T13:31:48.123+0000Z up", D(2024, 1, 8, 13, 31, 48, 123000), "isoT_dot_ms"),
    ("2024-01-08T13:31:48.123 up", D(2024, 1, 8, 13, 31, 48, 123000), "isoT_dot_ms"),
    ("2024-01-08T13:31:48+0530 up", D(2024, 1, 8, 8, 1, 48), "isoT_s_zone"),
    ("2024-01-08T13:31:48+05:30 up", D(2024, 1, 8, 13, 31, 48), "isoT_s"),
    ("Jan  8 10:00:00 host sshd", D(1900, 1, 8, 10, 0, 0), "syslog"),
    ("Feb 29 10:00:00 host sshd", None, None),
    ("29/Jan/2024 13:48:00 up", D(2024, 1, 29, 13, 48, 0), "dmy_slash"),
    ("[29/Jan/2024:13:48:00 +0000] up", D(2024, 1, 29, 13, 48, 0), "clf"),
    ("1706536080.123456 up", D(2024, 1, 29, 13, 48, 0, 123456), "epoch_fraction"),
    ("0001706536080 up", D(2024, 1, 29, 13, 48, 0), "epoch13"),
    ("1706536080123 up", None, None),
    ("2024-02-30 13:31:48 up", None, None),
    ("no time at all", None, None),
]


def _collect(df):
    return [(r.ts.replace(tzinfo=None) if r.ts else None, r.ts_layout)
            for r in df.orderBy("line_no").select("ts", "ts_layout").collect()]


def test_layout_table(spark):
    df = extract_timestamp(lines_df(spark, [c[0] for c in CASES]))
    got = _collect(df.select("line_no", F_ntz("ts"), "ts_layout"))
    assert got == [(c[1], c[2]) for c in CASES]


def F_ntz(c):
    from pyspark.sql import functions as F
    return F.col(c).cast("timestamp_ntz").alias(c)


def test_epoch_ms_opt_in(spark):
    df = extract_timestamp(lines_df(spark, ["1706536080123 up"]), epoch_ms=True)
    got = _collect(df.select("line_no", F_ntz("ts"), "ts_layout"))
    assert got == [(D(2024, 1, 29, 13, 48, 0, 123000), "epoch_ms")]


def test_layout_hint_prunes(spark):
    df = extract_timestamp(lines_df(spark, ["2024-01-08 13:31:48 up", "[29/Jan/2024:13:48:00 +0000]"]),
                           layouts=["clf"])
    got = _collect(df.select("line_no", F_ntz("ts"), "ts_layout"))
    assert got == [(None, None), (D(2024, 1, 29, 13, 48), "clf")]


def test_long_lines_are_scanned_whole(spark):
    line = "x" * 50_000 + " 2024-01-08 13:31:48 up"
    got = _collect(extract_timestamp(lines_df(spark, [line])).select("line_no", F_ntz("ts"), "ts_layout"))
    assert got == [(D(2024, 1, 8, 13, 31, 48), "iso_s")]


def test_user_layouts(spark):
    from logweft.functions.timestamps import LAYOUT_NAMES, strptime_layout
    own = strptime_layout("dots", r"\d{2}\.\d{2}\.\d{4} \d{2}h\d{2}", "dd.MM.yyyy HH'h'mm")
    lines = ["at 08.01.2024 13h31", "2024-01-08 13:31:48 08.01.2024 13h31", "none"]
    df = extract_timestamp(lines_df(spark, lines), layouts=[*LAYOUT_NAMES, own])
    assert _collect(df.select("line_no", F_ntz("ts"), "ts_layout")) == [
        (D(2024, 1, 8, 13, 31), "dots"), (D(2024, 1, 8, 13, 31, 48), "iso_s"), (None, None)]
    with pytest.raises(ValueError):
        extract_timestamp(lines_df(spark, lines), layouts=["no such layout"])


def test_whole_value_parse(spark):
    from pyspark.sql import functions as F
    vals = ["29/Jan/2024:13:48:00 +0000", "29/Jan/2024:13:48:00", "2024-01-08 13:31:48.1234",
            "2024-01-08 13:31:48+05:30", "x 2024-01-08 13:31:48", "1706536080.5", "Feb 29 10:00:00"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r.t for r in df.orderBy("i").select(
        parse_timestamp_value(F.col("v")).cast("timestamp_ntz").alias("t")).collect()]
    assert got == [D(2024, 1, 29, 13, 48), None, D(2024, 1, 8, 13, 31, 48, 123400),
                   D(2024, 1, 8, 8, 1, 48), None, D(2024, 1, 29, 13, 48, 0, 500000), None]


# ---- independent Python model of the scan rule ------------------------------
# Its patterns are built here from the shape of a time, not taken from the library.
def _shapes():
    for sep, name in ((" ", "iso"), ("T", "isoT")):
        clock = "[0-9]{4}-[0-9]{2}-[0-9]{2}" + sep + "[0-9]{2}:[0-9]{2}:[0-9]{2}"
        for mark, part in ((",", "_comma_ms"), ("[.]", "_dot_ms"), ("", "_s")):
            body = clock + (mark + "[0-9]{3}" if mark else "")
            tail = "Z?" if name + part == "isoT_dot_ms" else ""
            yield name + part + "_zone", body + r"\s?(?:Z|[-+][0-9]{4}" + tail + ")"
            yield name + part, body
    yield "syslog", r"[ADFJMNOS][a-z][a-z]\s[\s0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}"
    yield "dmy_slash", r"[0-9]{2}/[A-Za-z0-9_]+/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}"
    yield "clf", r"[0-9]{2}/[A-Za-z0-9_]+/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [-+][0-9]{4}"
    yield "epoch_fraction", r"[0-9]{10}[.][0-9]+"
    yield "epoch13", "[0-9]{13}"


def _model(line):
    for name, regex in _shapes():
        m = re.search(regex, line)
        if not m:
            continue
        t = m.group(0)
        try:
            if name.startswith("iso"):
                v = dt.datetime.fromisoformat(t)
            elif name == "syslog":
                v = dt.datetime.strptime(t, "%b %d %H:%M:%S")
            elif name == "dmy_slash":
                v = dt.datetime.strptime(t, "%d/%b/%Y %H:%M:%S")
            elif name == "clf":
                v = dt.datetime.strptime(t, "%d/%b/%Y:%H:%M:%S %z")
            elif name == "epoch_fraction":
                v = dt.datetime.fromtimestamp(float(t), dt.timezone.utc)
            else:
                v = dt.datetime.fromtimestamp(int(t), dt.timezone.utc)
        except (ValueError, OverflowError, OSError):
            continue
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v, name
    return None, None


PIECES = ["2024-01-08", " ", "T", "13:31:48", ",123", ".123", ".123456", "Z", "-0500", "+0000",
          " -0500", "Jan", "Feb", "  8", " 18", "29/Jan/2024", ":13:48:00", " 13:48:00",
          "1706536080", ".5", "0001706536080", "x", "[", "]", "2024-13-01", "99:99:99"]


def test_scan_matches_python_model(spark):
    rnd = random.Random(7)
    lines = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8))) for _ in range(600)]
    df = extract_timestamp(lines_df(spark, lines))
    got = _collect(df.select("line_no", F_ntz("ts"), "ts_layout"))
    want = [_model(x) for x in lines]
    bad = [(x, g, w) for x, g, w in zip(lines, got, want) if g != w]
    assert not bad, bad[:5]
