"""The canonical log table.

One row per line: ``file`` is the path (or the key of the text it came
from), ``file_order`` its rank in natural name order, ``line_no`` the 0-based
line number inside the file, ``byte_offset`` where the line starts (plain
files only), ``raw`` the text between two ``\\n`` and ``line`` the decoded,
stripped, tab-expanded text the operators look at.
"""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), True),
    T.StructField("file_order", T.IntegerType(), True),
    T.StructField("line_no", T.LongType(), True),
    T.StructField("byte_offset", T.LongType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("line", T.StringType(), True),
])

LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

# Fixed value of the reference behaviour: display abbreviates at 1,000
# characters. Every parser reads whole lines.
DISPLAY_CAP = 1_000
TAB_SIZE = 4
