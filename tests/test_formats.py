"""Line formats (FIXTURES §3), access-log fields and JSON columns."""

import json

from pyspark.sql import functions as F

from log_lines_helper import lines_df
from logweft.functions import formats

COMMON = '1.2.3.4 - - [29/Jan/2024:13:45:19 +0000] "GET /x HTTP/1.1" 200 107 "-"'
CASES = [
    ('{"a": 1}', "json"), ("[1]", "json"), ('"x"', "json"), ("1", "json"), ("null", "json"),
    ('{"a":1,"a":2}', "json"), ('  {"a": 1}  ', "json"),
    ('{"a":1} x', "default"), ("{bad", "default"), ("1,2", "default"), ("1, null", "default"),
    (COMMON, "common"), (COMMON + ' "Agent/1.0"', "common"),
    (COMMON + ' "Agent/1.0" s1 4242 example.com', "combined"),
    ('1.2.3.4 - - [29/Jan/2024:13:45:19 +0000] "GET /x HTTP/1.1" 200 107', "default"),
    ("", "default"), ("   ", "default"),
]


def test_dispatch(spark):
    df = formats.classify_lines(lines_df(spark, [c[0] for c in CASES]))
    got = [r.format for r in df.orderBy("line_no").collect()]
    assert got == [c[1] for c in CASES]


def test_json_check_agrees_with_python_json(spark):
    probes = ['{"a": [1, 2, {"b": null}]}', "true", "false", "-0", "01", "1e5", '"\\u00e9"',
              "[1,]", "{}", "[]", '{"a":}', "tru", '"a" "b"', "nul", "[[[]]]", '{"a":1}{"b":2}']
    want = []
    for p in probes:
        try:
            json.loads(p)
            want.append("json")
        except ValueError:
            want.append("default")
    df = formats.classify_lines(lines_df(spark, probes))
    assert [r.format for r in df.orderBy("line_no").collect()] == want


def test_access_fields(spark):
    lines = [COMMON + ' "Agent/1.0"', COMMON + ' "Agent/1.0" s1 4242 example.com',
             '1.2.3.4 - - [29/Jan/2024:13:45:19 +0000] "GET /x" - - "-"']
    df = formats.parse_access_log(lines_df(spark, lines))
    rows = df.orderBy("line_no").collect()
    a, b, c = rows
    assert (a.format, a.ip, a.date, a.request_method, a.path, a.request_version, a.status, a.length,
            a.referrer, a.referrer_clean, a.user_agent_clean) == (
        "common", "1.2.3.4", "[29/Jan/2024:13:45:19 +0000]", "GET", "/x", " HTTP/1.1", 200, 107,
        '-" "Agent/1.0', "-", "Agent/1.0")
    assert a.access_ts.replace(tzinfo=None).isoformat() == "2024-01-29T13:45:19"
    assert (b.format, b.date, b.timezone, b.user_agent, b.session_id, b.generation_time_micro,
            b.virtual_host, b.access_ts) == (
        "combined", "29/Jan/2024:13:45:19", "+0000", "Agent/1.0", "s1", 4242, "example.com", None)
    assert (c.format, c.request_version, c.status, c.length) == ("common", None, None, None)


def test_status_and_methods(spark):
    lines = [COMMON, COMMON.replace(" 200 ", " 404 "), COMMON.replace(" 200 ", " 999 "),
             "POST and GET and GETTER and get", "no method"]
    df = formats.parse_access_log(lines_df(spark, lines))
    classes = {r.status_class: r.requests for r in formats.status_class_counts(df).collect()}
    assert classes == {"2xx": 1, "4xx": 1, "other": 1}
    methods = {r.method: r.occurrences for r in formats.http_method_counts(df).collect()}
    assert methods == {"GET": 5, "POST": 1}


def test_json_columns(spark):
    df = formats.parse_json_lines(lines_df(spark, ['{"a": 1, "b": "x"}', '{"a": 2}', "nope", "1706536080.5"]))
    prof = {(r.key, r.value_type): r.lines for r in formats.json_key_profile(df).collect()}
    assert prof == {("a", "BIGINT"): 2, ("b", "STRING"): 1}
    ts = [r.json_ts for r in df.orderBy("line_no").collect()]
    assert ts[:3] == [None, None, None] and ts[3] is not None


def test_pretty_json(spark):
    from logweft.functions.lines import pretty_json
    df = pretty_json(lines_df(spark, ['{"a": {"b": [1, 2]}}', "not json"]))
    got = [r.pretty for r in df.orderBy("line_no").collect()]
    assert got == [json.dumps({"a": {"b": [1, 2]}}, indent=2), None]


def test_fast_patterns_equal_the_fixed_ones():
    """Random lines around both shapes: the same lines match and the groups are the same."""
    import random
    import re
    rng = random.Random(5)
    marks = ["a", "b", " ", " ", "[", '] "', '" ', ' "', '"', " HTTP/", '" "', " [", "]", "\n", " a"]
    some = lambda n: "".join(rng.choice(marks) for _ in range(rng.randint(0, n)))
    hits = 0
    for k in range(3000):
        if k % 3 == 0:
            line = some(22)
        else:
            line = (f"{some(2)} {some(2)} {some(2)} [{some(2)} {some(2)}] \"{some(2)} {some(2)}"
                    f"{rng.choice(['', ' HTTP/1'])}{some(1)}\" {some(2)} {some(1)} \"{some(3)}\"")
            if k % 2:
                line += f' "{some(2)}" {some(2)} {some(2)} {some(2)}'
        for fmt in (formats.COMMON_LOG, formats.COMBINED_LOG):
            slow, test, split = (re.fullmatch(x, line) for x in (fmt.regex, fmt.test, fmt.split))
            assert bool(slow) == bool(test) == bool(split), line
            if slow:
                hits += 1
                assert slow.groups() == split.groups(), line
    assert hits > 300


def test_long_lines(spark):
    import time
    body = "r" * 20_000
    lines = ['{"a": "' + body + '"}', COMMON.replace('"-"', f'"{body}"'),
             "w " * 2500 + '] "' + "w " * 2500, "a b c [d e] \"" + 'x" ' * 3000 + "y"]
    df = lines_df(spark, lines)
    formats.classify_lines(df.limit(1)).collect()
    t = time.perf_counter()
    rows = formats.parse_access_log(df).orderBy("line_no").collect()
    assert time.perf_counter() - t < 10
    assert [r.format for r in rows] == ["json", "common", "default", "default"]
    assert rows[1].status == 200 and rows[1].referrer == body


def test_user_format_with_new_groups(spark):
    own = formats.LineFormat("kv", r"(\w+)=(\w+)", ("key", "status"))
    df = formats.parse_access_log(lines_df(spark, ["a=7", COMMON, "other"]), formats=[*formats.LINE_FORMATS, own])
    got = [(r.format, r.key, r.status) for r in df.orderBy("line_no").collect()]
    assert got == [("kv", "a", 7), ("common", None, 200), ("default", None, None)]


def test_pretty_json_shapes(spark):
    from logweft.functions.lines import pretty_json
    texts = ['{"b":1,"a":[{},[],{"x":"1, {2}: [3]\\\\\\""}],"c":null}', "[]", "{}", "3", '"s"', '[1,[2,3]]']
    df = pretty_json(lines_df(spark, texts))
    assert [r.pretty for r in df.orderBy("line_no").collect()] == [json.dumps(json.loads(t), indent=2) for t in texts]


def test_json_is_exactly_one_value(spark):
    import json
    import random
    rnd = random.Random(13)
    parts = ['{', '}', '[', ']', ',', ':', '"a"', '"b"', '1', '-2.5e3', 'null', 'true', ' ', '"]["', '"}{"', 'x', '"end-"', "\\"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8))) for _ in range(6000)]
    texts += ['{"a":1} x', '{"a":1}]["b"}', '{"a":1},"x":{"b":2}', '[1] , [2]', '{"a":1}} {"c":{}', '"a" "b"', '"a","b"', 'null', '{}', '[]',
              '[1],"end-0"]', '{"a":{"b":[1,{"c":null}]}}', '{"a":1,"a":2}']

    def whole(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    got = formats.parse_json_lines(df).select("i", F.to_json("json").alias("j"), F.col("json").isNotNull().alias("ok"),
                                              formats.is_json_col("line").alias("is")).collect()
    for r in got:
        assert (r.ok, r["is"]) == (whole(texts[r.i]),) * 2, texts[r.i]
    values = {r.i: r.j for r in got if r.ok}
    assert len(values) > 150 and all(json.loads(values[i]) == json.loads(texts[i]) for i in values)


def test_one_parse_for_a_json_line(spark):
    df = spark.createDataFrame([('{"a":1}',)], "line string")
    out = formats.parse_json_lines(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    from logweft.functions.lines import pretty_json
    odd = spark.createDataFrame([('{"a":1} x',), ('{"a":[1,2]}',)], "line string")
    assert [r.pretty for r in pretty_json(odd).collect()] == [None, '{\n  "a": [\n    1,\n    2\n  ]\n}']


def test_key_profile_of_odd_values(spark):
    rows = ['{"a":1,"b":null,"c.d":[1]}', '[{"a":1}]', '"a"', "x", '{"a":"s"}', "{}"]
    df = formats.parse_json_lines(spark.createDataFrame([(x,) for x in rows], "line string"))
    got = {(r.key, r.value_type): r.lines for r in formats.json_key_profile(df).collect()}
    assert got == {("a", "BIGINT"): 1, ("a", "STRING"): 1, ("b", "VOID"): 1, ("c.d", "ARRAY<BIGINT>"): 1}


def test_long_lines_are_numbered_before_they_are_written(spark):
    """A text given as an expression is no part of what the numbering writes; swallowed agents of any text come off whole."""
    from logweft.operators.numbering import rank_within
    from logweft.sources import tables
    moved = []

    def watched(df, *args, **kw):
        moved.append(df.columns)
        return rank_within(df, *args, **kw)

    rows = spark.createDataFrame([(2, "b"), (0, "é"), (1, "x\" \"y")], "k long, agent string").withColumn("file", F.lit("long.log"))
    text = F.concat(F.lit('1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "é'), F.repeat(F.lit("r"), 20_000),
                    F.lit('" "'), F.col("agent"), F.lit('"'))
    tables.rank_within, kept = watched, tables.rank_within
    try:
        log = tables.logs_from_table(rows, text, "file", order_col="k")
    finally:
        tables.rank_within = kept
    assert moved == [["k", "agent", "file", "__file", "__order"]]
    out = formats.parse_access_log(log).orderBy("line_no").select("line_no", F.length("referrer_clean"), "user_agent_clean").collect()
    assert [tuple(r) for r in out] == [(0, 20_001, "é"), (1, 20_001, "x\" \"y"), (2, 20_001, "b")]


def test_common_lines_by_their_head(spark):
    """Any common line has the groups of the fixed pattern, taken by its head, with line feeds, separators and later
    quotes at which a longer request version could end."""
    import random
    import re
    rng = random.Random(9)
    marks = ["a", "b", " ", "[", '] "', '" ', ' "', '"', " HTTP/", '" "', " [", "]", "\n", " a", "\x01"]
    some = lambda n: "".join(rng.choices(marks, [9, 9, 18, 3, 3, 3, 3, 5, 3, 4, 3, 3, .3, 5, .3], k=rng.randint(0, n)))
    lines = []
    for _ in range(4000):
        version = rng.choice(["", " HTTP/1", " HTTP/1", ' HTTP/1"'])
        agent = rng.choice(["", '" "' + some(4)])
        lines.append(f'{some(1)} {some(1)} {some(1)} [{some(1)} {some(1)}] "{some(1)} {some(1)}{version}{some(1)}" {some(2)} {some(1)} "{some(4)}{agent}"')
    rows = formats.parse_access_log(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).collect()
    longer = 0
    for r in rows:
        found = re.fullmatch(formats.COMMON_LOG.regex, r.line)
        assert (r.format == "common") == bool(found), r.line
        if not found:
            continue
        g = found.groups()
        agent = re.fullmatch(r'(.*?)" "(.*)', g[9])
        assert (r.ip, r.remote_log_name, r.userid, r.date, r.request_method, r.path, r.request_version) == (*g[:6], g[6] or None), r.line
        assert (r.referrer, r.referrer_clean, r.user_agent_clean) == (g[9], *(agent.groups() if agent else (g[9], None))), r.line
        longer += (re.match(formats.COMMON_LOG.head, r.line[:-1]).group(7) or None) != (g[6] or None)
    assert longer > 300


def test_long_referrers_are_not_gone_through(spark):
    """The head of a common line ends where the referrer begins, and no search by single characters follows."""
    import re
    line = COMMON.replace('"-"', '"http://h/' + "r " * 6000 + '" "agent/1 (x y)"')
    assert re.match(formats.COMMON_LOG.head, line[:-1]).end() == line.index('"http') + 1
    df = formats.parse_access_log(lines_df(spark, [line, line.replace("r", "\t", 1), line.replace("r ", '" ', 1)]))
    assert "instr(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = df.orderBy("line_no").select("referrer_clean", "user_agent_clean").collect()
    assert [r.user_agent_clean for r in rows] == ["agent/1 (x y)"] * 2 + [None]      # a version that ends in the referrer
    assert rows[0].referrer_clean == "http://h/" + "r " * 6000


def test_lines_without_tabs_are_decoded(spark):
    from logweft.functions.lines import normalize_lines
    raw = [b"a\xffb", b"\xed\xa0\x80", b"\r\xc3\x28\r", "é�\U0001f600".encode(), b"", b"\xff\tx", b"\tx\r"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, b binary").selectExpr("i", "cast(b as string) raw")
    want = [r.c for r in df.select("i", F.make_valid_utf8("raw").alias("c")).orderBy("i").collect()]
    got = [r.line for r in normalize_lines(df).orderBy("i").collect()]
    assert got == [c.strip("\r\n").expandtabs(4) for c in want] and got[0] == "a�b"
