"""Entities: Spark's one-pass extraction against Python's finditer."""

import re

from pyspark.sql import functions as F

from log_lines_helper import lines_df
from logweft.functions import entities

# The rule spelt out for Python's engine, from the entities' definitions.
H2, H4 = "[0-9a-fA-F]{1,2}", "[0-9a-fA-F]{4}"


def macs(pairs, quads):
    return "|".join([f"{H2}(?:{mark}{H2}){{{pairs - 1}}}" for mark in "-:"] + [f"{H4}(?:[.]{H4}){{{quads - 1}}}"])


QUOTED = "|".join(f"b?{q}.*?(?<!\\\\){q}" for q in ("'''", "'", '"""', '"'))
KINDS = {
    "ipv4": "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}",
    "ipv6": "(?:[0-9a-fA-F]{1,4}:{1,2}){1,7}[0-9a-fA-F]{1,4}",
    "eui64": macs(8, 4), "eui48": macs(6, 3),
    "uuid": "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "bool_true": "True", "bool_false": "False", "none": "None",
    "number": r"(?<!\w)-?[0-9]+[.]?[0-9]*(?:e[+-]?\d+?)?\b|0x[0-9A-Fa-f]*",
    "str": QUOTED, "path": r"\[.*?\]",
}
BEFORE = {"bool_true": r"\b", "bool_false": r"\b", "none": r"\b", "str": r"(?<![\\\w])"}
PY_RX = re.compile("|".join(f"{BEFORE.get(k, '')}(?P<{k}>{rx})" + (r"\b" if BEFORE.get(k) == r"\b" else "")
                            for k, rx in KINDS.items()))


def model(line):
    out = []
    for m in PY_RX.finditer(line):
        for k, v in m.groupdict().items():
            if v:
                out.append((k, v))
    return out


LINES = [
    "from 192.168.1.10 to 10.0.0.1:8080", "mac 00:1a:2b:3c:4d:5e and 00-1A-2B-3C-4D-5E-6F-70",
    "cisco 0011.2233.4455 id 123e4567-e89b-12d3-a456-426614174000",
    "flags True False None Truely", "numbers -12 3.5 1e10 0xFF x1 é2", "time 13:45:19 ok",
    "say 'hi' and \"there\" b'bytes' '''triple'''", "path [a/b] [x]", "::1 fe80::1ff:fe23:4567:890a",
    "", "plain words only", "9.8.7.6 " + "x" * 20_000 + " 1.2.3.4", "escaped 'it\\'s' done",
]


def test_entities_match_python(spark):
    df = entities.extract_entities(lines_df(spark, LINES))
    got = {}
    for r in df.collect():
        got.setdefault(r.line_no, []).append((r.pos, r.kind, r.value))
    for i, line in enumerate(LINES):
        mine = [(k, v) for _, k, v in sorted(got.get(i, []))]
        assert mine == model(line), line


def test_entities_on_documents(spark):
    from logweft.sources.render import document_log
    df = document_log(spark, "/root/testdata/sf0.001")
    rows = df.select("line_no", "file", "line").collect()
    ent = entities.extract_entities(df).collect()
    got = {}
    for r in ent:
        got.setdefault((r.file, r.line_no), []).append((r.pos, r.kind, r.value))
    for r in rows:
        mine = [(k, v) for _, k, v in sorted(got.get((r.file, r.line_no), []))]
        assert mine == model(r.line), (r.file, r.line_no)


def test_counts_and_top(spark):
    df = entities.extract_entities(lines_df(spark, ["1.2.3.4 1.2.3.4 5.6.7.8 True"]))
    counts = {r.kind: (r.matches, r.distinct_values) for r in entities.entity_counts(df).collect()}
    assert counts == {"ipv4": (3, 2), "bool_true": (1, 1)}
    top = entities.top_entities(df, "ipv4", 1).collect()
    assert [(r.value, r.occurrences) for r in top] == [("1.2.3.4", 2)]


def test_document_counts_and_top(spark):
    from collections import Counter
    from logweft.plans.queries import REGISTRY
    from logweft.sources.render import document_log
    folder = "/root/testdata/sf0.001"
    found = Counter(x for r in document_log(spark, folder).select("line").collect() for x in model(r.line))
    counts = {r.kind: (r.matches, r.distinct_values) for r in REGISTRY["document_entity_counts"].build(spark, folder).collect()}
    kinds = {k for k, _ in found}
    assert counts == {k: (sum(n for (q, _), n in found.items() if q == k), sum(q == k for q, _ in found)) for k in kinds}
    top = {(r.kind, r.rank): (r.value, r.occurrences) for r in REGISTRY["document_top_entities"].build(spark, folder).collect()}
    want = {}
    for k in kinds:
        best = sorted(((v, n) for (q, v), n in found.items() if q == k), key=lambda x: (-x[1], x[0].encode()))[:10]
        want |= {(k, i): x for i, x in enumerate(best, 1)}
    assert top == want and top


def test_random_lines_match_python(spark):
    import random
    rnd = random.Random(11)
    parts = ["1", "12", ".", "e", "e5", "e-7", "-", "+", "x", "0x", "fe", "[", "]", "'", "'''", '"', '"""', "b", "\\", " ", "\n",
             ":", "::", "00:1a", "True", "None", "é", "٣", "_", "￿", "1.2.3.4", "0011.2233.4455", "ab-cd-ef", "1-2-3-4-5-6-7-8",
             "123e4567-e89b-12d3-a456-426614174000", "1234.5678.9abc.def0", "\r", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    got = {r.i: [(e.kind, e.value) for e in r.e] for r in df.select("i", entities.entities_col("line").alias("e")).collect()}
    wrong = [(texts[i], got[i], model(texts[i])) for i in got if got[i] != model(texts[i])]
    assert not wrong, wrong[:3]


def test_long_lines_take_linear_time(spark):
    import time
    n = 1_000_000
    lines = {"digits": "7" * n + "x", "brackets": "[" * n, "dots": "1." * (n // 2) + "x", "quotes": "\\'" * (n // 2) + "'",
             "escaped": "'" + "\\'" * (n // 2), "closed": "[" * (n // 2) + "]" + "[" * (n // 2), "hex": "fa" * (n // 2),
             "colons": "1:" * (n // 2), "exponents": "1e" * (n // 2), "triples": "'''" + "\\'''" * (n // 4), "dashes": "-" * n}
    spark.createDataFrame([("warm 1 [a]",)], "line string").select(entities.entities_col("line")).collect()
    for name, text in lines.items():
        df = spark.createDataFrame([(text,)], "line string").select(F.size(entities.entities_col("line")).alias("n")).cache()
        start = time.time()
        found = df.first().n
        assert time.time() - start < 10, name            # two seconds alone; tests share the machine
        if name in ("digits", "brackets", "hex", "dashes"):
            assert found == 0


def test_long_lines_in_pieces(spark, monkeypatch):
    """Lines cut into pieces give the entities of the whole line, whatever stands across the cuts."""
    import random
    rnd = random.Random(7)
    bits = [" ", " ", "'", '"', "[", "]", "'''", '"""', "\\", "b'", "don't", "Bob's", "12", "-3.5e4", "10.0.0.1", "fe80::1", "True", "é",
            "'a b'", "[x y]", '"p q"', "00-00-00-00-00-b'z'", "0xb'", "a'", "'c d 'e", "x\U0001f600", "word", "~"]
    lines = [" ".join(rnd.choices(bits, k=60)) if k % 2 else "".join(rnd.choices(bits, k=90)) for k in range(150)]
    lines += [" ~ ".join(f"1.2.3.{k} 'v' [/p/{k}] it's" for k in range(80)), "' " + "7 " * 200, "7 " * 200 + "'"]
    df = lines_df(spark, lines)
    c = F.col("line")
    rows = [tuple(r) for r in df.select("line_no", F.posexplode(entities.entities_col("line")).alias("pos", "e")).select(
        "line_no", "pos", "e.kind", "e.value").orderBy("line_no", "pos").collect()]
    monkeypatch.setattr(entities, "PIECE_CHARS", 20)
    got = entities.extract_entities(df).select("line_no", "pos", "kind", "value").orderBy("line_no", "pos")
    assert [tuple(r) for r in got.collect()] == rows
    pieces = [r[0] for r in df.orderBy("line_no").select(entities.pieces_col(c, 20)).collect()]
    assert ["".join(p) for p in pieces] == [x[0] for x in df.orderBy("line_no").select("line").collect()]
    assert len(pieces[150]) > 60 and len(pieces[151]) == 1 and len(pieces[152]) > 5


def _in_parts(rnd, texts, sizes):
    """Rows (key, part, text) that cut each text anywhere."""
    rows = []
    for key, t in texts:
        j = p = 0
        size = rnd.choice(sizes)
        while j < len(t) or not p:
            n = rnd.choice(size)
            rows.append((key, p, t[j:j + n]))
            j, p = j + n, p + rnd.choice([1, 3])
    rnd.shuffle(rows)
    return rows


def test_lines_that_come_in_pieces(spark, monkeypatch):
    """Lines cut anywhere give the entities of the whole line, with no row that holds a line."""
    import random
    rnd = random.Random(3)
    bits = [" ", " ", "'", '"', "[", "]", "'''", '"""', "\\", "b'", "don't", "12", "-3.5e4", "10.0.0.1", "fe80::1", "True", "é", "'a b'",
            "[x y]", "00-00-00-00-00-b'z'", "'c d 'e", "x\U0001f600", "word", "~"]
    lines = [" ".join(rnd.choices(bits, k=60)) if k % 2 else "".join(rnd.choices(bits, k=90)) for k in range(40)]
    lines += [" ~ ".join(f"1.2.3.{k} 'v' [/p/{k}] it's" for k in range(80)), "7 " * 100 + "'", "", "nothing"]
    rows = _in_parts(rnd, list(enumerate(lines)), [[1, 2, 3], [5, 9, 20], [100, 300], [0, 1, 70]])
    monkeypatch.setattr(entities, "PIECE_CHARS", 20)
    cut = spark.createDataFrame(rows, "line_no int, piece int, line string")
    held = entities._clean_pieces(cut.select("line_no", F.col("piece").alias("__part"), F.col("line").alias("__text")), ("line_no",), 20)
    held = held.orderBy("line_no", "__piece").collect()
    put = {}
    for r in held:
        put.setdefault(r.line_no, []).append(r["__text"])
    assert {k: "".join(v) for k, v in put.items()} == {k: t for k, t in enumerate(lines) if t}
    assert len(put[40]) > 40
    got = {}
    for r in entities.extract_entities(cut, keep=("line_no",), piece_col="piece").orderBy("line_no", "pos").collect():
        got.setdefault(r.line_no, []).append((r.pos, r.kind, r.value))
    for k, t in enumerate(lines):
        assert got.get(k, []) == [(i, *x) for i, x in enumerate(model(t))], t


def test_logs_from_parts_of_texts(spark):
    """Texts in parts are the log of the whole texts: lines, numbers, stripped ends and tab stops."""
    import random
    from logweft.sources.tables import logs_from_table
    rnd = random.Random(5)
    bits = ["a", "é", "\U0001f600", "\t", "\t", "\r", "\n", "\n", "\r\n", "word ", "x"]
    texts = ["", "\n", "\r\n", "a\n", "\n\n", "\r\r\ta\t\r"] + ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(60)]
    texts = [(f"f{i}", t) for i, t in enumerate(texts)]
    whole = logs_from_table(spark.createDataFrame(texts, "file string, text string"), "text", "file").collect()
    parts = spark.createDataFrame(_in_parts(rnd, texts, [[0, 1, 1, 2, 3, 8, 20]]), "file string, part int, text string")
    got = {}
    for r in logs_from_table(parts, "text", "file", part_col="part").orderBy("file", "line_no", "piece").collect():
        a = got.get((r.file, r.line_no), ("", ""))
        got[r.file, r.line_no] = (a[0] + r.raw, a[1] + r.line)
    assert got == {(r.file, r.line_no): (r.raw, r.line) for r in whole}


def test_joined_lines_hold_no_line_whole(spark):
    """The rendered lines come in parts of neighbouring ids, and are the same put together."""
    from logweft.sources.render import joined_lines
    ids = [*range(4090, 4100), 3, 12_000, 90_000]
    rows = [(f"f{k % 2}", k, f"t{k}") for k in ids]
    parts = joined_lines(spark.createDataFrame(rows, "file string, event_id long, text string"), " ~ ", last="!").orderBy("file", "part").collect()
    for f in ("f0", "f1"):
        mine = [r.text for r in parts if r.file == f]
        assert "".join(mine) == " ~ ".join(f"t{k}" for k in sorted(ids) if k % 2 == int(f[1])) + "!" and len(mine) > 1


def test_entities_are_found_once(spark):
    """No filter of the planner runs the extraction a second time."""
    plan = entities.extract_entities(lines_df(spark, ["1.2.3.4"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan
