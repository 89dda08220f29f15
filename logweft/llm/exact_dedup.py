"""Exact deduplication against a persistent digest index.

The index is a Spark table bucketed and sorted by digest, one row per distinct text ever kept. A batch of documents is
first reduced to one row per digest (map-side combined, so a group of copies of any size is one row per task), then
anti-joined with the index: the index side is read bucket by bucket without a shuffle, in a sort-merge join. What is
new is appended to the same buckets. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft.llm import common as c

#: Buckets of an index: 100 TB of 4 KB texts are about 25 G digests of 48 bytes, 300 MB a bucket at 4096.
BUCKETS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text; a null counts as empty. No normalisation."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def create_index(spark: SparkSession, name: str | None = None, buckets: int = BUCKETS) -> str:
    """An empty index table ``digest, keep_id``; gives its name. A named one is kept in the warehouse, one without a name
    has its files in the shared checkpoint folder (see :func:`drop_index`)."""
    c.prepare(spark)
    empty = spark.createDataFrame([], "digest string, keep_id long")
    if name is None:
        return c.bucketed_table(empty, buckets, "digest").table_name
    empty.write.bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    return name


def drop_index(spark: SparkSession, name: str) -> None:
    """Removes an index that was made without a name, files and all."""
    table = spark.table(name)
    table.table_name = name
    table.written_path = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first().data_type
    c.dropped(table)


def batch_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, keep_id, group_size``: the texts of a batch; of equal ones the largest id stays (null is smallest)."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
                .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def append_new(groups: DataFrame, index: str, buckets: int = BUCKETS) -> DataFrame:
    """Appends the digests the index lacks; gives them (``digest, keep_id, group_size``) as a written table."""
    spark = groups.sparkSession
    known = spark.table(index).select("digest")
    new = c.written(groups.join(known.hint("merge"), "digest", "left_anti"), "new-digests")
    (new.select("digest", "keep_id").repartition(buckets, "digest")
        .write.mode("append").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index))
    return new


def id_ranges(docs: DataFrame, batches: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` in up to so many ranges of ids, the largest first and rows without an id in the last."""
    number = F.col(id_col).cast("long")
    cuts = docs.select(number.alias("id")).approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    out, rest = [], F.lit(True)
    for cut in sorted({int(x) for x in cuts}, reverse=True):
        out.append(docs.filter(rest & (number >= cut)))
        rest = number.isNull() | (number < cut)
    return [*out, docs.filter(rest)]


def _through_index(docs: DataFrame, index: str, buckets: int, batches: int, id_col: str, text_col: str):
    """Takes ``docs`` through an index batch by batch; gives the groups and the new digests of all of them."""
    groups = new = None
    for part in id_ranges(docs, batches, id_col):
        own = c.written(batch_groups(part, id_col, text_col), "digests")
        fresh = append_new(own, index, buckets)
        groups, new = (own, fresh) if groups is None else (groups.unionByName(own), new.unionByName(fresh))
    return groups, new


def dedup_exact(docs: DataFrame, index: str | None = None, buckets: int = BUCKETS, id_col: str = "doc_id",
                text_col: str = "text", batches: int = 1) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per input row, dropped ones too.

    Texts already in ``index`` are all dropped (``keep_id`` is the indexed document). Of equal new texts the row with
    the largest id stays; of rows that also share that id, one. ``group_size`` counts the rows of ``docs``. Null
    texts count as empty and are equal to each other; a null id is smaller than any, and of a group of null ids one
    row stays with ``keep_id`` null. An empty table gives an empty result. Other columns are ignored.

    ``batches``: ranges of ids, the largest first, that go through the index one after the other; the result is the
    same for any number. Without ``index`` a new one is made, and dropped when the verdicts are written.

    The hot group: grouping combines map-side, and the join that brings the verdict back to the rows reads both
    sides through an exchange, so adaptive execution splits a digest that holds many rows.
    """
    spark = c.prepare(docs.sparkSession)
    name = index or create_index(spark, buckets=buckets)
    try:
        groups, new = _through_index(docs, name, buckets, batches, id_col, text_col)
        if batches > 1:
            groups = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
        held = spark.table(name).select("digest", F.col("keep_id").alias("held_id"))
        fresh = new.select("digest", F.lit(True).alias("fresh"))
        verdicts = c.written(groups.join(held.hint("merge"), "digest").join(fresh, "digest", "left")
                                   .select("digest", F.col("held_id").alias("keep_id"), "group_size",
                                           F.coalesce("fresh", F.lit(False)).alias("fresh")), "verdicts")
    finally:
        if index is None:
            drop_index(spark, name)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    marked = rows.join(verdicts, "digest")
    mine = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = marked.withColumn("mine", mine)
    # rows that repeat the id that stays: one of them is kept
    marked = marked.withColumn("row", F.when(F.col("mine"), F.monotonically_increasing_id()))
    twice = (marked.filter("mine").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())
    if twice:
        marked = c.written(marked, "rows")
        one = marked.filter("mine").groupBy("digest").agg(F.min("row").alias("one"))
        marked = marked.join(one, "digest", "left").withColumn("mine", F.col("mine") & (F.col("row") == F.col("one")))
    return marked.select("doc_id", "keep_id", "group_size", F.col("mine").alias("kept"),
                         F.col("digest").alias("text_sha256"))


def keep_new(docs: DataFrame, index: str | None = None, buckets: int = BUCKETS, id_col: str = "doc_id",
             text_col: str = "text", batches: int = 1) -> DataFrame:
    """The rows of ``docs`` that :func:`dedup_exact` keeps, all columns unchanged; their texts join the index."""
    spark = c.prepare(docs.sparkSession)
    name = index or create_index(spark, buckets=buckets)
    try:
        _, new = _through_index(docs, name, buckets, batches, id_col, text_col)
    finally:
        if index is None:
            drop_index(spark, name)
    digest, keep = c.free_name(docs, "digest"), c.free_name(docs, "keep_id")
    verdict = new.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    mine = F.col(id_col).cast("long").eqNullSafe(F.col(keep))
    rows = docs.withColumn(digest, text_digest(F.col(text_col))).join(verdict, digest).filter(mine)
    narrow = docs.select(F.col(id_col), text_digest(F.col(text_col)).alias(digest)).join(verdict, digest)
    if narrow.filter(mine).groupBy(digest).count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates([digest])       # rows that repeat the id that stays
    return rows.select(*docs.columns)
