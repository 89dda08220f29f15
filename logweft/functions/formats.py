"""Line formats: JSON, common and combined access logs, default.

Each line is classified on its own (one file may mix formats), in a fixed
order: JSON, then the access-log formats of :data:`LINE_FORMATS`, then
``default``. Blank lines are ``default``. Everything is Catalyst; a matched
access-log line is taken apart with *one* regex pass (``regexp_replace``
that rewrites the line to its groups joined by a separator).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweft.functions.timestamps import parse_timestamp_value


@dataclass(frozen=True)
class LineFormat:
    """A regex line format: full-match pattern and its group names in order.

    ``split`` (same groups) and ``test`` are optional faster forms: ``test``
    matches exactly the lines that ``regex`` matches, and on those ``split``
    gives exactly its groups.

    ``head`` is a form for long lines that ``regex`` matches if, and only if,
    they hold no line feed, end with ``end`` and begin, before that, with
    ``head``: its groups are those of ``regex`` but the last, which is all that
    stands between ``head`` and ``end`` and so is not gone through. Where
    ``head`` may take a group otherwise than ``regex``, :func:`_head_settled` says
    whether there was a choice.
    """

    name: str
    regex: str
    groups: tuple[str, ...]
    split: str | None = None
    test: str | None = None
    head: str | None = None
    end: str = ""

    @staticmethod
    def _whole(regex: str) -> str:
        # (?d): only \n ends a line for '.', as in Python; \z: whole text.
        return "(?d)^(?:" + regex + r")\z"

    @property
    def full_head(self) -> str:
        return "(?d)^(?:" + self.head + ")"

    @property
    def full(self) -> str:
        return self._whole(self.split or self.regex)

    @property
    def full_test(self) -> str:
        return self._whole(self.test or self.split or self.regex)


# The two access-log patterns (full match), with their group
# names in order. Java group names cannot hold '_', so groups are numbered.
#
# The fixed patterns backtrack over every blank and quote of a line that does
# not match. ``split`` and ``test`` say the same without that: a lazy group
# that ends at a delimiter ends at the *first* place where the rest can match,
# and a later place never helps the rest (what follows only needs delimiters
# in order), so it may be taken for good. The one greedy group, the request
# version, keeps its choice among the closing quotes.
COMMON_LOG = LineFormat(
    "common",
    r'(.*?) (.*?) (.*?) (\[.*?(?= ).*?\]) "(.*?) (.*?)( HTTP\/.*)?" (.*?) (.*?) "(.*?)"',
    ("ip", "remote_log_name", "userid", "date", "request_method", "path",
     "request_version", "status", "length", "referrer"),
    split=r'([^ \n]*+) ([^ \n]*+) (?>(.*?) (?=\[))(?>(\[[^ \n]*+ .*?\]) ")([^ \n]*+) '
          r'(.*?)( HTTP\/.*)?" ([^ \n]*+) (?>(.*?) ")(.*)"',
    test=r'[^ \n]*+ [^ \n]*+ (?>.*? (?=\[))(?>\[[^ \n]*+ .*?\] ")[^ \n]*+ (?>.*?" )[^ \n]*+ (?>.*? ").*"',
    head=r'([^ \n]*+) ([^ \n]*+) (?>(.*?) (?=\[))(?>(\[[^ \n]*+ .*?\]) ")([^ \n]*+) '
         r'(.*?)( HTTP\/.*?)?" ([^ \n]*+) (?>(.*?) ")',
    end='"',
)
COMBINED_LOG = LineFormat(
    "combined",
    r'(.*?) (.*?) (.*?) \[(.*?)(?= ) (.*?)\] "(.*?) (.*?)( HTTP\/.*)?" (.*?) (.*?) "(.*?)" "(.*?)" '
    r'(.*?) (.*?) (.*)',
    ("ip", "remote_log_name", "userid", "date", "timezone", "request_method", "path",
     "request_version", "status", "length", "referrer", "user_agent", "session_id",
     "generation_time_micro", "virtual_host"),
    split=r'([^ \n]*+) ([^ \n]*+) (?>(.*?) \[)([^ \n]*+) (?>(.*?)\] ")([^ \n]*+) (.*?)( HTTP\/.*)?" '
          r'([^ \n]*+) (?>(.*?) ")(?>(.*?)" ")(?>(.*?)" )([^ \n]*+) ([^ \n]*+) (.*)',
    test=r'[^ \n]*+ [^ \n]*+ (?>.*? \[)[^ \n]*+ (?>.*?\] ")[^ \n]*+ (?>.*?" )[^ \n]*+ (?>.*? ")'
         r'(?>.*?" ")(?>.*?" )[^ \n]*+ [^ \n]*+ .*',
)

# Registry of regex formats, tried in this order after JSON.
LINE_FORMATS: list[LineFormat] = [COMMON_LOG, COMBINED_LOG]

ACCESS_FIELDS = ("ip", "remote_log_name", "userid", "date", "timezone", "request_method",
                 "path", "request_version", "status", "length", "referrer", "user_agent",
                 "session_id", "generation_time_micro", "virtual_host")
INT_FIELDS = {"status": "int", "length": "bigint", "generation_time_micro": "bigint"}

# The request methods counted as words (case-sensitive).
HTTP_METHODS = ("GET", "POST", "PUT", "HEAD", "DELETE", "OPTIONS", "PATCH")

# Separator for the one-pass group split; lines holding it use the slow path.
_SEP = "\u0001"


def holds(c: Column, mark: str) -> Column:
    """Whether a text holds a character. ``contains`` looks at one byte after
    the other; splitting at a single character that means nothing to a regex
    searches as Java does, many bytes at once, and stops at the first."""
    return F.size(F.split(c, mark, 2)) > 1


def strip_ends(c: Column, marks: str) -> Column:
    """``btrim``, which walks through the whole text, only where a mark stands at an end."""
    held = F.lit(False)
    for m in marks:
        held = held | c.startswith(m) | c.endswith(m)
    return F.when(held, F.btrim(c, F.lit(marks))).otherwise(c)


def _strip_ws(c: Column) -> Column:
    return strip_ends(c, " \t\n\r\u000b\u000c")


# A JSON scalar line is one of these; anything else must be an object,
# array or string (first and last character agree) to be worth parsing.
_JSON_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"


def _json_end(value: Column) -> Column:
    """A string that ends a parse: no text holds the hash of itself."""
    return F.concat(F.lit("end-"), F.hex(F.xxhash64(value)))


def _json_probe(value: Column) -> Column:
    """``[value, "end"]`` as VARIANT, from a text that may be a JSON value.

    The parser ignores text behind a value, and a text such as ``1] [2`` would
    close a bracket put around it. The end string behind the value shows both:
    it is element 1 only if the text before it is exactly one value.
    """
    return F.try_parse_json(F.concat(F.lit("["), value, F.lit(',"'), _json_end(value), F.lit('"]')))


def _json_scalar(value: Column) -> Column:
    """Whether the text is a JSON scalar; a look at its end first, for long lines."""
    ends = F.lit(False)
    for last in "0123456789el":
        ends = ends | value.endswith(last)
    return ends & value.rlike(_JSON_SCALAR)


def _json_container(value: Column) -> Column:
    """Whether first and last character agree with an object, array or string."""
    ends = lambda a, b: value.startswith(a) & value.endswith(b)
    return ends("{", "}") | ends("[", "]") | (ends('"', '"') & (F.octet_length(value) > 1))


def is_json_col(col: Column | str) -> Column:
    """True when the (stripped) text is exactly one JSON value of any type.

    Scalars are decided by their shape, containers by one parse.
    NaN / Infinity are not JSON to Spark (Python accepts them).
    """
    return _is_json(_strip_ws(F.col(col) if isinstance(col, str) else col))


def _is_json(v: Column) -> Column:
    whole = F.coalesce(F.try_variant_get(_json_probe(v), "$[1]", "string") == _json_end(v), F.lit(False))
    return F.when(_json_scalar(v), F.lit(True)).when(_json_container(v), whole).otherwise(F.lit(False))


def _guard(text: Column, fmt: LineFormat) -> Column:
    """Cheap test before a built-in pattern: both need '] "'."""
    return text.contains('] "') if fmt in (COMMON_LOG, COMBINED_LOG) else F.lit(True)


def _before_end(text: Column, fmt: LineFormat) -> Column:
    """The text without the ``end`` of its format, taken off by bytes: to count characters is to walk through them."""
    return F.substring(text.cast("binary"), F.lit(1), F.octet_length(text) - len(fmt.end.encode())).cast("string")


def _may_have_head(text: Column, fmt: LineFormat) -> Column:
    return text.endswith(fmt.end) & ~holds(text, "\n")


def _is_format(text: Column, fmt: LineFormat) -> Column:
    if fmt.head is None:
        return text.rlike(fmt.full_test)
    return _may_have_head(text, fmt) & _before_end(text, fmt).rlike(fmt.full_head)


def format_col(col: Column | str = "line", formats: Sequence[LineFormat] | None = None,
               known: dict[str, Column] | None = None, stripped: Column | None = None) -> Column:
    """The dispatch: 'json', a registered regex format name, or 'default'.
    ``known`` says of formats whether a line matches, where that is found
    already, ``stripped`` is a column that holds the text without blanks around it."""
    text = F.col(col) if isinstance(col, str) else col
    bare = _strip_ws(text) if stripped is None else stripped
    chain = F.when(bare == "", F.lit("default")).when(_is_json(bare), F.lit("json"))
    for fmt in LINE_FORMATS if formats is None else formats:
        matches = (known or {}).get(fmt.name)
        chain = chain.when(_guard(text, fmt) & _is_format(text, fmt) if matches is None else matches, F.lit(fmt.name))
    return chain.otherwise(F.lit("default"))


def classify_lines(df: DataFrame, col: str = "line", out: str = "format",
                   formats: Sequence[LineFormat] | None = None) -> DataFrame:
    return df.withColumn(out, format_col(col, formats))


def _groups(text: Column, fmt: LineFormat) -> Column:
    """All groups of a full match as an array, in one regex pass."""
    replacement = _SEP.join(f"${i}" for i in range(1, len(fmt.groups) + 1))
    fast = F.split(F.regexp_replace(text, fmt.full, replacement), _SEP)
    slow = F.array(*[F.regexp_extract(text, fmt.full, i) for i in range(1, len(fmt.groups) + 1)])
    return F.when(~holds(text, _SEP), fast).otherwise(slow)


def _by_head(text: Column, fmt: LineFormat) -> Column:
    """The line without its ``end``, its ``head`` rewritten to groups and separators: another text if, and only if, the
    format matches (a line without its ``end``: NULL)."""
    replacement = "".join(f"${i}{_SEP}" for i in range(1, len(fmt.groups)))
    return F.regexp_replace(text, fmt.full_head, replacement)


def _blank_part(parts: Column) -> Column:
    """Place (from 1) of the first ``" "`` in a text parted at its quotes: a part of one blank with quotes on both sides;
    1 if there is none."""
    return F.array_position(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), " ").cast("int") + 1


def _joined(parts: Column, start: Column, count: Column) -> Column:
    return F.when(count == 1, F.get(parts, start - 1)).otherwise(F.array_join(F.slice(parts, start, count), '"'))


def _head_settled(groups: Column, parts: Column, at: Column) -> Column:
    """Whether the request version of the common format, which ``head`` takes
    as short as it can be and ``regex`` as long, has one end only.

    At a later one the rest, ``" status length "`` and more, would begin: a
    quote before a blank and, two blanks on, a blank before a quote that is not
    the last. The quotes are those around the referrer and in it (``parts``).
    If it holds ``" "`` (at ``at``), the blank of that may be the first of the
    three, and the last is in what follows it.
    """
    referrer = groups[9]
    quiet = ~groups[7].contains('"') & ~groups[8].contains('"')
    before = (at == 2) | ~_joined(parts, F.lit(1), at - 1).contains('" ')         # one part: no quote
    agent = _joined(parts, at + 1, F.size(parts) - at)
    one = F.when(F.size(parts) == 1, F.lit(True)).when(at > 1, ~referrer.startswith(" ") & before & ~agent.contains(' "')) \
           .otherwise(~referrer.contains(' "'))
    return F.coalesce(parts.isNotNull() & ((groups[6] == "") | (quiet & one)), F.lit(False))


def parse_access_log(df: DataFrame, col: str = "line", format_out: str = "format",
                     formats: Sequence[LineFormat] | None = None) -> DataFrame:
    """Access-log columns for lines classified as one of the regex formats.

    Adds the format, every group as a typed column (``status`` INT,
    ``length`` and ``generation_time_micro`` BIGINT, the rest STRING),
    ``access_ts`` (the bracketed date through the whole-value time parse:
    common lines keep their zone; combined lines lose it and stay NULL),
    and ``referrer_clean`` / ``user_agent_clean``: a usual NCSA-combined line
    is a *common* line whose referrer swallowed ``" "user agent``.

    ``formats`` are the regex formats to try, in order (default: the
    registry). Groups of a user's format that the built-in formats lack
    become string columns of that name.
    """
    chosen = list(LINE_FORMATS if formats is None else formats)
    text = F.col(col)
    tmp, body, told, head, parts, at, settled = "__access_groups", "__body", "__told", "__head", "__parts", "__at", "__settled"
    # the common format by its head: one pass over the head both matches and parts a line
    by_head = COMMON_LOG in chosen and [x.name for x in chosen].count(COMMON_LOG.name) == 1
    may = _guard(text, COMMON_LOG) & _may_have_head(text, COMMON_LOG)
    df = df.withColumn(body, F.when(may, _before_end(text, COMMON_LOG)) if by_head else F.lit(None).cast("string"))
    df = df.withColumn(told, _by_head(F.col(body), COMMON_LOG))
    matched = F.coalesce(F.col(told) != F.col(body), F.lit(False))
    if format_out not in df.columns:
        df = df.withColumn(head, _strip_ws(text))
        df = df.withColumn(format_out, format_col(text, chosen, {COMMON_LOG.name: matched} if by_head else None, F.col(head)))
    fmt_c = F.col(format_out)
    groups_expr = F.lit(None).cast("array<string>")
    for fmt in chosen:
        groups_expr = F.when(fmt_c == fmt.name, _groups(text, fmt)).otherwise(groups_expr)
    df = df.withColumn(head, F.when(matched & (fmt_c == COMMON_LOG.name), F.split(told, _SEP)))
    df = df.withColumn(parts, F.when(F.size(head) == len(COMMON_LOG.groups), F.split(F.col(head)[9], '"'))) \
           .withColumn(at, _blank_part(F.col(parts)))
    df = df.withColumn(settled, _head_settled(F.col(head), F.col(parts), F.col(at)))
    df = df.withColumn(tmp, F.when(F.col(settled), F.col(head)).otherwise(groups_expr))
    g = F.col(tmp)
    cols = {}
    extra = dict.fromkeys(x for fmt in chosen for x in fmt.groups if x not in ACCESS_FIELDS)
    for field in (*ACCESS_FIELDS, *extra):
        expr = F.lit(None).cast("string")
        for fmt in chosen:
            if field in fmt.groups:
                val = F.try_element_at(g, F.lit(fmt.groups.index(field) + 1))
                expr = F.when(fmt_c == fmt.name, val).otherwise(expr)
        if field == "request_version":
            expr = F.when(expr != "", expr)
        if field in INT_FIELDS:
            expr = (expr).try_cast(INT_FIELDS[field])
        cols[field] = expr
    df = df.withColumns(cols)
    date_value = F.when(fmt_c == "common", F.regexp_replace(F.col("date"), r"^\[+|\]+$", "")) \
                  .otherwise(F.col("date"))
    # (.*?)" "(.*) over a whole referrer without line feeds, by its quotes: no regex over long text
    df = df.withColumn(parts, F.when(fmt_c != "common", None).when(F.col(settled), F.col(parts)).when(
        ~holds(F.col("referrer"), "\n"), F.split("referrer", '"')))
    df = df.withColumn(at, F.when(F.col(settled), F.col(at)).otherwise(_blank_part(F.col(parts))))
    return (df.withColumn("access_ts", F.when(F.col("date").isNotNull(),
                                              parse_timestamp_value(date_value)))
              .withColumn("referrer_clean",
                          F.when(F.col(at) > 1, _joined(F.col(parts), F.lit(1), F.col(at) - 1))
                           .otherwise(F.col("referrer")))
              .withColumn("user_agent_clean",
                          F.when(F.col(at) > 1, _joined(F.col(parts), F.col(at) + 1, F.size(F.col(parts)) - F.col(at)))
                           .otherwise(F.col("user_agent")))
              .drop(tmp, body, told, head, parts, at, settled))


def parse_json_lines(df: DataFrame, col: str = "line", out: str = "json") -> DataFrame:
    """JSON lines as a VARIANT column (NULL for lines that are not JSON),
    plus ``json_ts``: the whole line through the whole-value time parse.

    One parse a line checks and types it."""
    v = _strip_ws(F.col(col))
    may = _json_container(v) | _json_scalar(v)
    probed = df.withColumn("__probe", F.when(may, _json_probe(v))) \
               .withColumn("__value", F.when(F.try_variant_get("__probe", "$[1]", "string") == _json_end(v),
                                             F.try_variant_get("__probe", "$[0]", "variant")))
    return (probed.withColumn(out, F.col("__value"))
                  .withColumn("json_ts", F.when(F.col("__value").isNotNull(), parse_timestamp_value(v)))
                  .drop("__probe", "__value"))


def status_class_col(status: Column | str = "status") -> Column:
    """'1xx' ... '5xx' by the first digit of the status text, else 'other'."""
    s = F.col(status) if isinstance(status, str) else status
    first = F.left(s.cast("string"), F.lit(1))
    return F.when(first.isin("1", "2", "3", "4", "5"), F.concat(first, F.lit("xx"))) \
            .otherwise(F.lit("other"))


def _is_access() -> Column:
    return F.col("format").isin([f.name for f in LINE_FORMATS])


# Access-log aggregates group every line and drop the non-access group
# afterwards by an *aggregated* flag. A filter on ``format`` (or on a grouping
# key) would be pushed down through the projections, and Catalyst would copy
# the whole classification expression into it once per reference.


def status_class_counts(df: DataFrame) -> DataFrame:
    """Requests per status class over lines parsed as access logs."""
    access = _is_access()
    cls = F.when(access, status_class_col(F.col("status")))
    return (df.groupBy(cls.alias("status_class"))
              .agg(F.count(F.lit(1)).alias("requests"), F.max(access).alias("__access"))
              .filter(F.col("__access")).drop("__access"))


def http_method_counts(df: DataFrame, col: str = "line") -> DataFrame:
    """Occurrences of each request-method word in any line (no word
    boundary, case-sensitive), the words a log viewer highlights."""
    rx = "(" + "|".join(HTTP_METHODS) + ")"
    words = F.explode(F.regexp_extract_all(F.col(col), F.lit(rx), 1))
    return (df.select(words.alias("method"))
              .groupBy("method").agg(F.count(F.lit(1)).alias("occurrences")))


def access_log_summary(df: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Traffic table: requests and bytes per ``by`` over access-log lines."""
    access = _is_access()
    return (df.groupBy(access.alias("__key"), *by)
              .agg(F.count(F.lit(1)).alias("requests"),
                   F.sum("length").alias("bytes"),
                   F.min("access_ts").alias("first_ts"),
                   F.max("access_ts").alias("last_ts"),
                   F.max(access).alias("__access"))
              .filter(F.col("__access")).drop("__access", "__key"))


def format_profile(df: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Lines per file and format."""
    if "format" not in df.columns:
        df = classify_lines(df)
    return df.groupBy(*by, "format").agg(F.count(F.lit(1)).alias("lines"))


def json_key_profile(df: DataFrame, col: str = "json") -> DataFrame:
    """Top-level keys of JSON object lines: value type and number of lines."""
    # Lines that are not JSON give no members, elements of arrays have no key.
    members = df.sparkSession.tvf.variant_explode(F.col(col).outer())
    keyed = df.select(col).lateralJoin(members).select("key", F.col("value").alias("_value")).filter("key IS NOT NULL")
    return (keyed.groupBy("key", F.schema_of_variant("_value").alias("value_type"))
                 .agg(F.count(F.lit(1)).alias("lines")))
