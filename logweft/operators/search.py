"""Search: literal or regex, with or without case; hits, spans, next /
previous hit, hits per file, vocabulary and word completion.

A search is a filter pushed into the scan stage and run in parallel; "next
hit after line n" is a distributed top-1 (``orderBy(...).limit(1)``, which
plans as TakeOrderedAndProject), never a loop over lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the characters that separate words for the vocabulary and
# completion index (whitespace, slash, brackets, parentheses, double quote).
SPLIT_RX = r'(?U)[\s/\[\]\(\)"/]'
_NOT_SPLIT_AT_END = r'(?U)[^\s/\[\]\(\)"/]*$'

# Noncharacters that mark matches (never part of text interchange).
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def java_quote(text: str) -> str:
    """A Java regex matching ``text`` literally (as ``Pattern.quote``)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


@dataclass(frozen=True)
class Search:
    """What to look for: ``find``, as a regex or a literal, with or without case."""

    find: str
    regex: bool = False
    case_sensitive: bool = False

    def __post_init__(self):
        if not self.find:
            raise ValueError("empty search text")
        if self.regex:
            validate_regex(self.find)

    @property
    def pattern(self) -> str:
        """The Java regex used for spans and counts."""
        body = self.find if self.regex else java_quote(self.find)
        return body if self.case_sensitive else "(?iu)" + body

    def matches(self, col: Column | str = "line") -> Column:
        c = F.col(col) if isinstance(col, str) else col
        if self.regex:
            return c.rlike(self.pattern)
        if self.case_sensitive:
            return c.contains(self.find)
        return F.lower(c).contains(self.find.lower())


def validate_regex(pattern: str) -> None:
    """Refuse a pattern the JVM regex engine cannot compile, before any job runs."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as err:  # py4j wraps PatternSyntaxException
            raise ValueError(f"invalid regex {pattern!r}: {err}") from None
    else:
        try:
            re.compile(pattern)
        except re.error as err:
            raise ValueError(f"invalid regex {pattern!r}: {err}") from None


def _search(find: str | Search, regex: bool = False, case_sensitive: bool = False) -> Search:
    return find if isinstance(find, Search) else Search(find, regex, case_sensitive)


def search(df: DataFrame, find: str | Search, regex: bool = False, case_sensitive: bool = False,
           col: str = "line") -> DataFrame:
    """Lines that hold ``find``. Empty lines are ordinary rows."""
    return df.filter(_search(find, regex, case_sensitive).matches(col))


def search_literal(df: DataFrame, find: str, col: str = "line") -> DataFrame:
    return search(df, find, regex=False, case_sensitive=True, col=col)


def search_ignore_case(df: DataFrame, find: str, col: str = "line") -> DataFrame:
    return search(df, find, regex=False, case_sensitive=False, col=col)


def search_regex(df: DataFrame, pattern: str, case_sensitive: bool = False,
                 col: str = "line") -> DataFrame:
    return search(df, pattern, regex=True, case_sensitive=case_sensitive, col=col)


def match_spans(df: DataFrame, find: str | Search, regex: bool = False,
                case_sensitive: bool = False, col: str = "line") -> DataFrame:
    """Add ``match_count`` and ``spans`` (ARRAY<STRUCT<start, end>>, 0-based,
    end exclusive) of all non-overlapping matches in each line.

    One pass puts a marker on both sides of every match, empty ones too (the
    engine's own search order); starts and ends follow from the lengths of the
    pieces. Characters of the line that look like a marker are first replaced
    by a third noncharacter of the same length, so any line works.
    """
    s = _search(find, regex, case_sensitive)
    c = F.col(col)
    clean = F.translate(c, _OPEN + _CLOSE, _OTHER + _OTHER)
    marked = F.split(F.regexp_replace(clean, s.pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    # each piece after the first: the match, the closing marker, the gap behind it
    sizes = F.transform(F.slice(marked, 2, F.size(marked)), lambda x: F.struct(
        (F.instr(x, _CLOSE) - 1).alias("m"), (F.length(x) - F.instr(x, _CLOSE)).alias("gap")))
    init = F.struct(F.length(F.element_at(marked, 1)).alias("pos"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc.pos
        end = start + x.m
        return F.struct((end + x.gap).alias("pos"),
                        F.array_append(acc.spans, F.struct(start.alias("start"),
                                                           end.alias("end"))).alias("spans"))

    spans = F.aggregate(sizes, init, step).spans
    return df.withColumn("spans", spans).withColumn("match_count", F.size("spans")) \
             .select(*[x for x in df.columns if x not in ("match_count", "spans")], "match_count", "spans")


def _file_ties(df: DataFrame) -> list[Column]:
    """Order of lines at the same position in several files."""
    return [F.col(x).asc() for x in ("file_order", "file") if x in df.columns]


def find_next(df: DataFrame, find: str | Search, after: int | None = None,
              regex: bool = False, case_sensitive: bool = False, col: str = "line",
              position: str = "line_no") -> DataFrame:
    """The first hit after position ``after`` (at or after 0 when None).

    Empty result = no hit (the pointer stays). Filter + distributed top-1.
    """
    s = _search(find, regex, case_sensitive)
    cond = s.matches(col)
    if after is not None:
        cond = cond & (F.col(position) > F.lit(after))
    return df.filter(cond).orderBy(F.col(position).asc(), *_file_ties(df)).limit(1)


def find_previous(df: DataFrame, find: str | Search, before: int | None = None,
                  regex: bool = False, case_sensitive: bool = False, col: str = "line",
                  position: str = "line_no") -> DataFrame:
    """The last hit before position ``before`` (the last hit when None)."""
    s = _search(find, regex, case_sensitive)
    cond = s.matches(col)
    if before is not None:
        cond = cond & (F.col(position) < F.lit(before))
    return df.filter(cond).orderBy(F.col(position).desc(), *_file_ties(df)).limit(1)


def next_hits(df: DataFrame, find: str | Search, after: int | None = None,
              regex: bool = False, case_sensitive: bool = False, col: str = "line",
              by: tuple[str, ...] = ("file",), position: str = "line_no",
              direction: str = "next") -> DataFrame:
    """Next (or previous) hit of every file at once: one aggregate."""
    s = _search(find, regex, case_sensitive)
    cond = s.matches(col)
    if after is not None:
        pos = F.col(position)
        cond = cond & ((pos > F.lit(after)) if direction == "next" else (pos < F.lit(after)))
    agg = F.min(position) if direction == "next" else F.max(position)
    return df.filter(cond).groupBy(*by).agg(agg.alias("hit_line_no"))


def search_summary(df: DataFrame, find: str | Search, regex: bool = False,
                   case_sensitive: bool = False, col: str = "line",
                   by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Hits per file: count, first and last hit line."""
    s = _search(find, regex, case_sensitive)
    return (df.filter(s.matches(col)).groupBy(*by)
              .agg(F.count(F.lit(1)).alias("hits"),
                   F.min("line_no").alias("first_hit"),
                   F.max("line_no").alias("last_hit")))


def tokens_col(col: Column | str = "line") -> Column:
    """Words of a line (longer than one character) as an array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, SPLIT_RX, -1), lambda w: F.length(w) > 1)


def _words(df: DataFrame, col: str, out: str) -> DataFrame:
    # explode, then a row filter: stays in generated code (no lambda).
    return (df.select(F.explode(F.split(F.col(col), SPLIT_RX, -1)).alias(out))
              .filter(F.length(out) > 1))


def token_counts(df: DataFrame, col: str = "line") -> DataFrame:
    """Vocabulary: words longer than one character and how often they occur."""
    return _words(df, col, "token").groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))


def typed_lengths(typed: DataFrame, col: str = "typed") -> list[int]:
    """The lengths of the last words of typed texts: what a completion index
    for them needs. A handful of integers (one per distinct length)."""
    last = F.length(F.regexp_extract(F.col(col), _NOT_SPLIT_AT_END, 0))
    return sorted(r[0] for r in typed.select(last.alias("n")).distinct().collect() if r[0])


def suggest_words(df: DataFrame, col: str = "line", lengths: Sequence[int] | None = None) -> DataFrame:
    """Completion index ``(prefix, word)``.

    Every word gives its lower-cased prefixes of length 1 .. len-2, or of the
    ``lengths`` asked for (see :func:`typed_lengths`: a long word then gives a
    few prefixes instead of one for each of its characters); a prefix
    completes to its longest word (ties: the greatest word, so the result is
    deterministic). Words are de-duplicated before prefixes are exploded,
    and both aggregates combine map-side, so a hot prefix is no hot task.
    """
    words = _words(df, col, "word").filter(F.length("word") >= 3).distinct()
    sizes = (F.sequence(F.lit(1), F.length("word") - 2) if lengths is None else
             F.filter(F.array(*[F.lit(int(n)) for n in lengths]).cast("array<int>"),
                      lambda n: n <= F.length("word") - 2))
    prefixes = words.select("word", F.explode(sizes).alias("n"))
    return (prefixes.groupBy(F.lower(F.col("word").substr(F.lit(1), F.col("n"))).alias("prefix"))
                    .agg(F.max_by("word", F.struct(F.length("word"), F.col("word")))
                          .alias("word")))


def complete(index: DataFrame, text: str) -> DataFrame:
    """Suggestion for the last word of ``text`` from a :func:`suggest_words`
    index: ``text`` with its last word completed (empty if none)."""
    last = re.split(r'[\s/\[\]\(\)"/]', text)[-1]
    if not last:
        return index.limit(0).select(F.lit(None).cast("string").alias("suggestion"))
    head = text[: len(text) - len(last)]
    return (index.filter(F.col("prefix") == last.lower())
                 .select(F.concat(F.lit(head), F.col("word")).alias("suggestion")))


def complete_all(index: DataFrame, typed: DataFrame, col: str = "typed",
                 out: str = "suggestion") -> DataFrame:
    """:func:`complete` for a whole column of typed texts: an equi-join of
    each text's lower-cased last word with the completion index. NULL when
    the last word is empty or has no completion; texts without a last word
    (NULL texts too) take no part in the join."""
    last = F.regexp_extract(F.col(col), _NOT_SPLIT_AT_END, 0)
    keyed = typed.withColumn("__last", last)
    has_word = F.coalesce(F.col("__last") != "", F.lit(False))
    idx = index.select(F.col("prefix").alias("__prefix"), F.col("word").alias("__word"))
    joined = keyed.filter(has_word).join(idx, F.lower(F.col("__last")) == F.col("__prefix"), "left")
    head = F.expr(f"substring(`{col}`, 1, length(`{col}`) - length(__last))")
    found = joined.withColumn(out, F.when(F.col("__word").isNotNull(), F.concat(head, F.col("__word"))))
    none = keyed.filter(~has_word).withColumn(out, F.lit(None).cast("string"))
    return found.drop("__prefix", "__word").unionByName(none).drop("__last")
