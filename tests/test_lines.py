"""Line projections against Python's own string rules."""

from pyspark.sql import functions as F

from logweft.functions import lines as L


def _one(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in df.orderBy("i").select(fn(F.col("t")).alias("o")).collect()]


def test_expand_tabs_like_python(spark):
    texts = ["a\tb", "\t", "abcd\te", "ab\tcd\t\tx", "no tabs", "x\ry\tz", "é\tb", ""]
    assert _one(spark, texts, L.expand_tabs_col) == [t.expandtabs(4) for t in texts]


def test_strip_ansi_and_unfold(spark):
    texts = ["\x1b[31mred\x1b[0m ok", "\x1b[1;32mbold\x1b[m", "plain"]
    assert _one(spark, texts, L.strip_ansi_col) == ["red ok", "bold", "plain"]
    assert _one(spark, ["a\\nb", "none"], L.unfold_newlines_col) == ["a\nb", "none"]


def test_abbreviate_and_caps(spark):
    long = "x" * 1500
    assert _one(spark, [long, "short"], L.abbreviate_col) == ["x" * 1000 + "…", "short"]
    from logweft.functions.lines import detail_text
    df = spark.createDataFrame([("z" * 150_000 + "\\n",)], "line string")
    assert detail_text(df).first().detail == "z" * 150_000 + "\n"


def test_expand_tabs_with_the_marker_character(spark):
    texts = ["a\tb\ue000\tc", "\ue000\t\tx\ry\t", "\ue000", "\ue000\t\ufdd0\tz", "\ufdd0\t"]
    assert _one(spark, texts, L.expand_tabs_col) == [t.expandtabs(4) for t in texts]


def test_normalize(spark):
    df = spark.createDataFrame([(0, "\r\n  a\tb\r\n"), (1, "")], "i int, raw string")
    got = [r.line for r in L.normalize_lines(df).orderBy("i").collect()]
    assert got == ["  a b", ""]


def test_expand_tabs_random_like_python(spark):
    import random
    rnd = random.Random(3)
    alphabet = ["a", "bc", "\t", "\t\t", "\r", "é", "x y", "😀", "1234"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    assert _one(spark, texts, L.expand_tabs_col) == [t.expandtabs(4) for t in texts]


def test_expand_tabs_without_markers_and_on_long_lines(spark):
    texts = ["﷐﷯\ta\t﷯", "a\u0001\t\tb\r\t \n\tx"]
    assert _one(spark, texts, L.expand_tabs_col) == [t.expandtabs(4) for t in texts]
    long = ["a😀" * 25_000 + "\t" + "x", "a😀b\t" * 250_000, "\t" * 1_000_000, ("ab" * 400_000 + "\tc") * 2, "😀" * 1_000_000 + "\t"]
    for t in long:
        assert _one(spark, [t], L.expand_tabs_col) == [t.expandtabs(4)]
