"""Log tables from literal lines, for the unit tests."""

from logweft.functions.lines import normalize_lines


def lines_df(spark, lines, file="f"):
    """A log table from literal lines (file, line_no, raw, line)."""
    rows = [(file, i, t) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, raw string")
    return normalize_lines(df)
