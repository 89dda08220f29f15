"""Search: filters, spans against Python finditer, next / previous, completion."""

import re

import pytest

from log_lines_helper import lines_df
from logweft.operators import search

LINES = ["Error: disk full", "all good", "ERROR again error", "", "the end of errors",
         "ab ab aab", "a\tb"]


def test_filters(spark):
    df = lines_df(spark, LINES)
    ids = lambda d: sorted(r.line_no for r in d.collect())
    assert ids(search.search_literal(df, "error")) == [2, 4]
    assert ids(search.search_ignore_case(df, "error")) == [0, 2, 4]
    assert ids(search.search_regex(df, r"^E\w+")) == [0, 2]
    assert ids(search.search_regex(df, r"^E\w+", case_sensitive=True)) == [0, 2]
    assert ids(search.search_regex(df, r"^e\w+", case_sensitive=True)) == []
    with pytest.raises(ValueError):
        search.Search("")
    with pytest.raises(ValueError):
        search.Search("a(b", regex=True)


@pytest.mark.parametrize("find,regex,case", [("ab", False, True), ("AB", False, False),
                                             (r"a+b", True, True), ("error", False, False),
                                             (r"(?=ab)", True, True), (r"\b", True, True), ("x*", True, True),
                                             (r"(e)(r)+", True, True), ("o|$", True, True),
                                             (".", False, True)])
def test_spans_match_python(spark, find, regex, case):
    df = search.match_spans(lines_df(spark, LINES), find, regex=regex, case_sensitive=case)
    got = {r.line_no: (r.match_count, [(s.start, s.end) for s in r.spans]) for r in df.collect()}
    pat = find if regex else re.escape(find)
    for i, line in enumerate(LINES):
        line = line.expandtabs(4)
        ms = list(re.finditer(pat, line, 0 if case else re.IGNORECASE))
        assert got[i] == (len(ms), [m.span() for m in ms]), line


def test_next_previous(spark):
    df = lines_df(spark, LINES)
    nxt = search.find_next(df, "error", after=0).collect()
    assert [r.line_no for r in nxt] == [2]
    assert [r.line_no for r in search.find_next(df, "error").collect()] == [0]
    assert search.find_next(df, "error", after=4).count() == 0
    assert [r.line_no for r in search.find_previous(df, "error", before=4).collect()] == [2]
    hits = search.search_summary(df, "error").collect()
    assert [(r.hits, r.first_hit, r.last_hit) for r in hits] == [(3, 0, 4)]


def test_tokens_and_completion(spark):
    df = lines_df(spark, ["GET /api/items (fast) \"quoted\"", "getting items", "a b"])
    toks = {r.token: r.occurrences for r in search.token_counts(df).collect()}
    assert toks == {"GET": 1, "api": 1, "items": 2, "fast": 1, "quoted": 1, "getting": 1}
    index = search.suggest_words(df)
    sug = {r.prefix: r.word for r in index.collect()}
    assert sug["g"] == "getting" and sug["ge"] == "getting" and sug["it"] == "items"
    assert "getti" in sug and "gettin" not in sug
    assert [r.suggestion for r in search.complete(index, "find /it").collect()] == ["find /items"]


def test_complete_all(spark):
    df = lines_df(spark, ["getting items", "GET /api"])
    index = search.suggest_words(df)
    typed = spark.createDataFrame([(0, "find /it"), (1, "x ge"), (2, "none "), (3, "zzz")],
                                  "i int, typed string")
    got = {r.i: r.suggestion for r in search.complete_all(index, typed).collect()}
    assert got == {0: "find /items", 1: "x getting", 2: None, 3: None}
