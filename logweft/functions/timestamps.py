"""Event times found in free text.

A line is searched for each layout in a fixed order; the first layout whose
pattern is found in the line *and* whose text parses gives the time. All of
it is Catalyst expressions: ``rlike`` guards, ``regexp_extract`` and
``try_to_timestamp`` - no Python per row, so it runs inside whole-stage
codegen on a batch table and on a stream alike.

Times without a zone are read in the session time zone (UTC in this
library's sessions).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Layout:
    """One timestamp layout: a search pattern and how to parse what it found.

    ``kind`` is ``iso`` (ISO-8601 style text), ``strptime`` (a fixed pattern
    with month names) or ``epoch``; it decides how the whole-value parse of
    :func:`parse_timestamp_value` treats a failure.
    """

    name: str
    regex: str
    kind: str
    parse: Callable[[Column], Column]


def _p(pattern: str) -> Callable[[Column], Column]:
    return lambda m: F.try_to_timestamp(m, F.lit(pattern))


def _drop_blank_before_zone(pattern: str) -> Callable[[Column], Column]:
    # "2024-01-08 13:31:48 -0500": the optional blank after the seconds is
    # accepted when there is no fraction; remove it and parse the rest.
    def parse(m: Column) -> Column:
        return F.try_to_timestamp(
            F.concat(F.left(m, F.lit(19)), F.regexp_replace(F.substring(m, 20, 64), r"^\s", "")),
            F.lit(pattern))
    return parse


def _syslog(m: Column) -> Column:
    # No year in the text: the year is 1900, so Feb 29 does not parse.
    return F.try_to_timestamp(F.concat(F.lit("1900 "), F.regexp_replace(m, r"\s+", " ")),
                              F.lit("yyyy MMM d HH:mm:ss"))


def _epoch_fraction(m: Column) -> Column:
    # Seconds with a fraction; decimal arithmetic keeps microseconds exact.
    micros = F.bround((m).try_cast("decimal(38,18)") * F.lit(1_000_000), 0)
    return F.timestamp_micros(micros.cast("bigint"))


# Largest epoch second that is still a valid time (9999-12-31 23:59:59 UTC).
MAX_EPOCH_SECONDS = 253_402_300_799


def _epoch13_seconds(m: Column) -> Column:
    # Thirteen digits read as *seconds*: present-day millisecond values are
    # beyond year 9999 and give no time.
    n = (m).try_cast("bigint")
    return F.when(n <= F.lit(MAX_EPOCH_SECONDS), F.timestamp_seconds(n))


def _epoch13_millis(m: Column) -> Column:
    return F.timestamp_millis((m).try_cast("bigint"))


# The seventeen search patterns of the timestamp scan, in the
# order they are tried (first that matches and parses wins).
TIMESTAMP_LAYOUTS: list[Layout] = [
    Layout("iso_comma_ms_zone", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}\s?(?:Z|[+-]\d{4})", "iso",
           _p("yyyy-MM-dd HH:mm:ss,SSSXX")),
    Layout("iso_comma_ms", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}", "iso",
           _p("yyyy-MM-dd HH:mm:ss,SSS")),
    Layout("iso_dot_ms_zone", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s?(?:Z|[+-]\d{4})", "iso",
           _p("yyyy-MM-dd HH:mm:ss.SSSXX")),
    Layout("iso_dot_ms", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}", "iso",
           _p("yyyy-MM-dd HH:mm:ss.SSS")),
    Layout("iso_s_zone", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\s?(?:Z|[+-]\d{4})", "iso",
           _drop_blank_before_zone("yyyy-MM-dd HH:mm:ssXX")),
    Layout("iso_s", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "iso",
           _p("yyyy-MM-dd HH:mm:ss")),
    Layout("isoT_comma_ms_zone", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d{3}\s?(?:Z|[+-]\d{4})", "iso",
           _p("yyyy-MM-dd'T'HH:mm:ss,SSSXX")),
    Layout("isoT_comma_ms", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d{3}", "iso",
           _p("yyyy-MM-dd'T'HH:mm:ss,SSS")),
    Layout("isoT_dot_ms_zone", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\s?(?:Z|[+-]\d{4}Z?)", "iso",
           _p("yyyy-MM-dd'T'HH:mm:ss.SSSXX")),
    Layout("isoT_dot_ms", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}", "iso",
           _p("yyyy-MM-dd'T'HH:mm:ss.SSS")),
    Layout("isoT_s_zone", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\s?(?:Z|[+-]\d{4})", "iso",
           _drop_blank_before_zone("yyyy-MM-dd'T'HH:mm:ssXX")),
    Layout("isoT_s", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "iso",
           _p("yyyy-MM-dd'T'HH:mm:ss")),
    Layout("syslog", r"[JFMASOND][a-z]{2}\s(\s|\d)\d \d{2}:\d{2}:\d{2}", "strptime", _syslog),
    Layout("dmy_slash", r"\d{2}\/\w+\/\d{4} \d{2}:\d{2}:\d{2}", "strptime",
           _p("dd/MMM/yyyy HH:mm:ss")),
    Layout("clf", r"\d{2}\/\w+\/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}", "strptime",
           _p("dd/MMM/yyyy:HH:mm:ss XX")),
    Layout("epoch_fraction", r"\d{10}\.\d+", "epoch", _epoch_fraction),
    Layout("epoch13", r"\d{13}", "epoch", _epoch13_seconds),
]

# Opt-in: thirteen digits read as epoch milliseconds instead.
EPOCH_MS_LAYOUT = Layout("epoch_ms", r"\d{13}", "epoch", _epoch13_millis)

LAYOUT_NAMES = [layout.name for layout in TIMESTAMP_LAYOUTS]


# Every built-in layout holds one of these; a line without is left at once.
_ANY_TIME = r"\d{2}:\d{2}:\d{2}|\d{10}\.\d|\d{13}"


def _select_layouts(layouts: Sequence[str | Layout] | None, epoch_ms: bool) -> list[Layout]:
    """Named built-in layouts in their fixed order, then a user's own in the
    order given; all built-in ones when ``layouts`` is None."""
    chosen = list(TIMESTAMP_LAYOUTS)
    if epoch_ms:
        chosen = [EPOCH_MS_LAYOUT if lay.name == "epoch13" else lay for lay in chosen]
    if layouts is not None:
        own = [lay for lay in layouts if isinstance(lay, Layout)]
        wanted = {lay for lay in layouts if not isinstance(lay, Layout)}
        unknown = wanted - {lay.name for lay in chosen}
        if unknown:
            raise ValueError(f"unknown timestamp layouts: {sorted(unknown)}")
        chosen = [lay for lay in chosen if lay.name in wanted] + own
    return chosen


def _hit(text: Column, layout: Layout) -> Column:
    return F.struct(layout.parse(F.regexp_extract(text, layout.regex, 0)).alias("ts"),
                    F.lit(layout.name).alias("layout"))


def strptime_layout(name: str, regex: str, pattern: str) -> Layout:
    """A user's own layout: a Java regex to search and the datetime pattern
    that what it found must parse with."""
    return Layout(name, regex, "strptime", _p(pattern))


def timestamp_struct(col: Column | str, layouts: Sequence[str | Layout] | None = None,
                     epoch_ms: bool = False) -> tuple[Column, Column]:
    """Two expressions: the first-found layout, and the full fallback chain.

    The first is evaluated for every line: the first layout whose pattern
    occurs, with its parse (one regex pass per layout tried, one parse).
    Only when that parse fails (an impossible date, a blank before a zone
    after a fraction, ...) is the second, slower chain used, which keeps
    looking through the later layouts.
    """
    text = F.col(col) if isinstance(col, str) else col
    chosen = _select_layouts(layouts, epoch_ms)
    hits = [F.when(text.rlike(lay.regex), _hit(text, lay)) for lay in chosen]
    first = F.coalesce(*hits)
    if all(lay in TIMESTAMP_LAYOUTS or lay is EPOCH_MS_LAYOUT for lay in chosen):
        first = F.when(text.rlike(_ANY_TIME), first)
    # Every layout tried, the first whose parse succeeded; evaluated only on
    # the rare lines whose first-found layout did not parse. (A CASE chain
    # here would keep the stage in generated code, but makes the fused method
    # too large for the JIT: measured slower.)
    chain = F.try_element_at(F.filter(F.array(*hits), lambda h: h.ts.isNotNull()), F.lit(1))
    return first, chain


def extract_timestamp(df: DataFrame, col: str = "line", out: str = "ts",
                      layout_out: str = "ts_layout", layouts: Sequence[str | Layout] | None = None,
                      epoch_ms: bool = False) -> DataFrame:
    """Add ``ts`` (TIMESTAMP) and ``ts_layout`` (name of the layout that hit).

    ``layouts`` restricts the search to some layouts (for example the ones
    :func:`timestamp_profile` found in a file), which prunes regex work; it
    may also hold a user's own :class:`Layout` (see :func:`strptime_layout`).
    """
    first, chain = timestamp_struct(col, layouts, epoch_ms)
    tmp = "__ts_hit"
    # ``__ts_hit`` is referenced twice below; Catalyst keeps it in its own
    # projection (it is not cheap), so the regex chain runs once per line.
    df = df.withColumn(tmp, first)
    hit = F.when(F.col(tmp).ts.isNotNull(), F.col(tmp)).otherwise(
        F.when(F.col(tmp).isNotNull(), chain))
    df = df.withColumn(tmp, hit)
    return (df.withColumn(out, F.col(tmp).ts)
              .withColumn(layout_out, F.col(tmp).layout)
              .drop(tmp))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 as a double; untimed lines give 0.0 (merge key)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.unix_micros(c) / F.lit(1_000_000.0), F.lit(0.0))


def scan_timestamps(df: DataFrame, col: str = "line") -> DataFrame:
    """Per line ``(file, line_no, epoch)``; 0.0 where a line has no time."""
    timed = extract_timestamp(df, col)
    return timed.select("file", "line_no", epoch_seconds("ts").alias("epoch"))


def _iso_whole(v: Column) -> Column:
    # A whole value in ISO form: day, any one separator, time, optional
    # fraction, optional zone; a blank before the zone only without fraction.
    rx = r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(\s?)(Z|[+-]\d{2}:?\d{2})?$"
    day = F.regexp_extract(v, rx, 1)
    time = F.regexp_extract(v, rx, 2)
    frac = F.regexp_extract(v, rx, 3)
    blank = F.regexp_extract(v, rx, 4)
    zone = F.regexp_extract(v, rx, 5)
    zone_norm = (F.when(zone == "Z", F.lit("+00:00"))
                  .when(F.length(zone) == 5,
                        F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
                  .otherwise(zone))
    text = F.concat(day, F.lit(" "), time, F.lit("."), F.rpad(F.left(frac, F.lit(6)), 6, "0"), zone_norm)
    ok = v.rlike(rx) & ~((frac != "") & (blank != "")) & ~((blank != "") & (zone == ""))
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS[XXX]")))


def parse_timestamp_value(col: Column | str) -> Column:
    """Whole-value parse of a field that should be nothing but a time.

    A layout is picked by searching its pattern anywhere in the value; then
    the *whole* value must parse. An ISO or epoch value that fails lets the
    search go on; a month-name layout that fails ends it with NULL.

    All ISO layouts share one whole-value ISO parse and come first, so they
    collapse into one branch guarded by the part every ISO pattern starts
    with (day, blank or T, seconds).
    """
    v = F.col(col) if isinstance(col, str) else col
    iso = _iso_whole(v)
    out = F.when(v.rlike(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}") & iso.isNotNull(), iso)
    for lay in TIMESTAMP_LAYOUTS:
        if lay.kind == "iso":
            continue
        val = F.when(v.rlike("^(?:" + lay.regex + ")$"), lay.parse(v))
        cond = v.rlike(lay.regex)
        if lay.kind == "epoch":
            cond = cond & val.isNotNull()
        out = out.when(cond, val)
    return out


def timestamp_profile(df: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Lines per file and timestamp layout (NULL layout = untimed), with the
    first and last time and the share of the file's lines.

    The layouts a file uses can be fed back to ``extract_timestamp(...,
    layouts=...)`` to skip the others.
    """
    per = (df.groupBy(*by, "ts_layout")
             .agg(F.count(F.lit(1)).alias("lines"),
                  F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    w = Window.partitionBy(*by)
    return per.withColumn("share", F.col("lines") / F.sum("lines").over(w))
