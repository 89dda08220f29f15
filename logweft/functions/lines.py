"""Line projections (column expressions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft.functions.formats import holds, is_json_col, strip_ends
from logweft.schema import DISPLAY_CAP, TAB_SIZE

# ANSI / VT100 control sequence introducer followed by parameters and a final
# byte; this is what a colour code looks like in a log line.
ANSI_RX = "\u001b\\[[0-9;?]*[ -/]*[@-~]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_lenient(col: Column | str) -> Column:
    """Invalid UTF-8 byte sequences become U+FFFD."""
    return F.make_valid_utf8(_c(col))


def strip_line_ends(col: Column | str) -> Column:
    """Drop ``\\r`` and ``\\n`` at both ends; blank lines stay blank."""
    return strip_ends(_c(col), "\r\n")


def expand_tabs_col(col: Column | str, tabsize: int = TAB_SIZE) -> Column:
    """Tabs to spaces with a stop every ``tabsize`` columns (as Python's
    ``str.expandtabs``: the column restarts after ``\r`` or ``\n``).

    After a tab the column is a multiple of ``tabsize``, so the padding of
    each tab depends only on the length, modulo ``tabsize``, of the text
    between it and the tab, line break or start before it. One regex pass per
    remainder expands those tabs; the blanks it writes make that text a
    multiple of ``tabsize`` long, so the next pass may take them for text. No
    lambda, so it stays in generated code; the repeat is possessive, which
    Java runs as a loop whatever the characters' widths, so a pass is linear
    and needs no stack.
    """
    c = _c(col)
    out = c
    for r in range(tabsize):
        rx = f"(?<=^|[\t\r\n])((?:[^\t\r\n]{{{tabsize}}})*+[^\t\r\n]{{{r}}})\t"
        out = F.regexp_replace(out, rx, "$1" + " " * (tabsize - r))
    return F.when(holds(c, "\t"), out).otherwise(c)


def strip_ansi_col(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), ANSI_RX, "")


def abbreviate_col(col: Column | str, width: int = DISPLAY_CAP) -> Column:
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)


def unfold_newlines_col(col: Column | str) -> Column:
    """The two characters backslash + n become a real line break."""
    return F.replace(_c(col), F.lit("\\n"), F.lit("\n"))


def normalize_lines(df: DataFrame, raw: str = "raw", out: str = "line",
                    tabsize: int = TAB_SIZE) -> DataFrame:
    """``raw`` -> ``line``: lenient decode, strip line ends, expand tabs.

    What stands before the first tab is the text itself only if it has no tab
    and, as the search decodes and encodes it, is valid: one fast pass over a
    long line in place of two by single bytes."""
    c, plain, text = _c(raw), "__plain", "__text"
    df = df.withColumn(plain, F.get(F.split(c, "\t", 2), F.lit(0)) == c)
    df = df.withColumn(text, strip_line_ends(F.when(F.col(plain), c).otherwise(decode_lenient(c))))
    return df.withColumn(out, F.when(F.col(plain), F.col(text)).otherwise(expand_tabs_col(text, tabsize))).drop(plain, text)


def line_start(text: Column, tabsize: int = TAB_SIZE) -> tuple[Column, Column]:
    """Whether the column restarts inside a piece of a line, and how far the
    piece moves it (from 0 where it restarts)."""
    restarts = text.contains("\t") | text.contains("\r") | text.contains("\n")
    tail = text
    for mark in "\t\r\n":
        tail = F.substring_index(tail, mark, -1)
    return restarts, F.length(F.when(restarts, tail).otherwise(text)) % tabsize


def normalize_piece_col(raw: Column | str, first: Column, last: Column, column: Column, tabsize: int = TAB_SIZE) -> Column:
    """:func:`normalize_lines` for a piece of a line: its ends are stripped
    where the line begins (``first``) and ends (``last``), tabs go on from the
    column that the pieces before reach."""
    c, marks = decode_lenient(raw), F.lit("\r\n")
    c = F.when(first & (c.startswith("\r") | c.startswith("\n")), F.ltrim(c, marks)).otherwise(c)
    c = F.when(last & (c.endswith("\r") | c.endswith("\n")), F.rtrim(c, marks)).otherwise(c)
    whole = F.concat(F.repeat(F.lit("x"), column), c)
    return F.when(c.contains("\t"), F.substr(expand_tabs_col(whole, tabsize), column + F.lit(1))).otherwise(c)


def expand_tabs(df: DataFrame, col: str = "line", tabsize: int = TAB_SIZE) -> DataFrame:
    return df.withColumn(col, expand_tabs_col(col, tabsize))


def strip_ansi(df: DataFrame, col: str = "line", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, strip_ansi_col(col))


def abbreviate(df: DataFrame, col: str = "line", width: int = DISPLAY_CAP,
               out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, abbreviate_col(col, width))


def detail_text(df: DataFrame, col: str = "line", out: str = "detail",
                width: int | None = None) -> DataFrame:
    """The detail view of a line: ``\\n`` unfolded; whole unless a ``width`` is given."""
    shown = _c(col) if width is None else abbreviate_col(col, width)
    return df.withColumn(out, unfold_newlines_col(shown))


def unfold_newlines(df: DataFrame, col: str = "line", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, unfold_newlines_col(col))


# One JSON token: a string, a mark, or a run of other characters.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'


def pretty_json(df: DataFrame, col: str = "line", out: str = "pretty") -> DataFrame:
    """JSON lines printed with a 2-space indent; NULL when the line is not
    JSON. Keys keep their order and values their spelling.

    A fold over the line's tokens that carries the depth and the token before.
    """
    c = _c(col)
    tokens = F.regexp_extract_all(c, F.lit(_JSON_TOKEN), F.lit(0))
    opens = lambda t: t.isin("{", "[")

    def step(acc, t):
        closing = t.isin("}", "]")
        depth = acc.depth + F.when(opens(t), 1).when(closing, -1).otherwise(0)
        line = lambda d: F.concat(F.lit("\n"), F.repeat(F.lit("  "), d))
        text = (F.when(closing & ~opens(acc.before), F.concat(line(depth), t))
                 .when(t == ":", F.lit(": "))
                 .when(~closing & (t != ",") & (opens(acc.before) | (acc.before == ",")),
                       F.concat(line(acc.depth), t))
                 .otherwise(t))
        return F.struct(depth.alias("depth"), t.alias("before"), F.concat(acc.text, text).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("before"), F.lit("").alias("text"))
    return df.withColumn(out, F.when(is_json_col(c), F.aggregate(tokens, start, step).text))


def line_stats(df: DataFrame, by: tuple[str, ...] = ("file",), col: str = "line") -> DataFrame:
    """Line count, widest line (characters) and text bytes per group."""
    return (df.groupBy(*by)
              .agg(F.count(F.lit(1)).alias("lines"),
                   F.max(F.length(col)).alias("max_width"),
                   F.sum(F.octet_length(col)).alias("text_bytes")))
