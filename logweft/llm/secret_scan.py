"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of secret is a pattern. Matches are leftmost and non-overlapping per kind; their places follow from the
lengths of the pieces that ``split`` leaves between the matches that ``regexp_extract_all`` gives, summed in a window
over one text's matches. Equal texts are scanned as one (spans depend on the text only).

The base kinds are always reported. The further kinds are candidates: their values are hashed and counted over the
corpus by distinct repositories and owners. A value that many owners have is a copied example and adds no span; a
value of few owners that looks live (letters and digits mixed, no placeholder word, no single repeated character) does.
The same count labels the base matches as owner-specific or widely copied. Distinct (value, repository, owner) rows are
formed map-side before the shuffle, so a value that sits in a third of all documents costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft.llm import common as c


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds its value, and the least length of that value."""
    name: str
    pattern: str
    group: int
    least: int
    base: bool = False


# The base patterns of the scan, then the further kinds of candidate. ASCII classes are spelt out, so
# that every regex engine reads them alike.
KINDS = (
    Kind("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                   r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 8, True),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 16, True),
    Kind("hex", r"([0-9a-f]{32,})", 1, 32, True),      # runs of 32 or more: the same matches as longer runs kept
    Kind("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]+=*)", 1, 16),
    Kind("url", r"[a-z][a-z0-9+.-]{0,20}://[A-Za-z0-9._%-]+:([^\x09-\x0D\x20/:@]+)@", 1, 6),
    Kind("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 32),
    Kind("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    Kind("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 1, 20),
    Kind("private", r"(-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]+)", 1, 64),
)
PLACEHOLDER = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]|[Pp][Ll][Aa][Cc][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Xx]{6}|0{6}|\*{3}"

#: A value of more owners, or of more repositories, than this is a copied example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4


def _matches(text: Column, kind: Kind) -> Column:
    """Array of ``gap`` (code points since the last match), ``size`` and ``value``; the gap after the last is left."""
    rx = F.lit(kind.pattern)
    found = F.arrays_zip(F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x)).alias("gap"),
                         F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.length(x)).alias("size"),
                         F.regexp_extract_all(text, rx, F.lit(kind.group)).alias("value"))
    rows = F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"),
                                                 x["value"].alias("value")))
    return F.when(text.rlike(kind.pattern), F.filter(rows, lambda x: x["size"].isNotNull()))


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, no placeholder word, more than one distinct character."""
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)
            & (F.replace(value, F.substring(value, F.lit(1), F.lit(1)), F.lit("")) != ""))


def find_matches(texts: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``digest, kind_no, start, stop, value`` of every match long enough, from ``digest, text`` rows (equal digests are
    one text). Code points, ``stop`` exclusive."""
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind_no"), _matches(F.col("text"), kind).alias("found"))
                         for k, kind in enumerate(kinds)])
    rows = (texts.select("digest", F.explode(per_kind).alias("k"))
                 .select("digest", "k.kind_no", F.posexplode("k.found").alias("i", "m"))
                 .select("digest", "kind_no", "i", "m.gap", "m.size", "m.value")
                 .dropDuplicates(["digest", "kind_no", "i"]))
    before = Window.partitionBy("digest", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(kind.least) for kind in kinds]), F.col("kind_no") + 1)
    return (rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before))
                .filter(F.length("value") >= least)
                .select("digest", "kind_no", (F.col("stop") - F.col("size")).alias("start"), "stop", "value"))


def ownership(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """``value_hash, n_owners, n_repositories`` of all candidate values; ``documents``: ``digest, repository, owner``."""
    pairs = (matches.select("digest", F.sha2("value", 256).alias("value_hash")).distinct()
                    .join(documents.distinct(), "digest")
                    .select("value_hash", "repository", "owner").distinct())
    return pairs.groupBy("value_hash").agg(F.countDistinct("owner").alias("n_owners"),
                                           F.countDistinct("repository").alias("n_repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, text_col: str = "text",
         kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS,
         max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``digest, spans`` per distinct text with a span; ``spans`` is a sorted array of ``start, kind_no, kind, stop, base,
    shared`` (``shared``: the value is widely copied)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
    found = c.written(find_matches(rows, kinds), "matches")
    held = docs.select(F.sha2(text, 256).alias("digest"), repository.alias("repository"), owner.alias("owner"))
    counts = ownership(found, held).withColumn(
        "shared", (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))
    base = F.element_at(F.array(*[F.lit(kind.base) for kind in kinds]), F.col("kind_no") + 1)
    name = F.element_at(F.array(*[F.lit(kind.name) for kind in kinds]), F.col("kind_no") + 1)
    judged = (found.withColumn("value_hash", F.sha2("value", 256))
                   .join(counts.select("value_hash", "shared"), "value_hash").withColumn("base", base)
                   .filter(F.col("base") | (~F.col("shared") & live_looking(F.col("value")))))
    span = F.struct("start", "kind_no", name.alias("kind"), "stop", "base", "shared")
    return judged.groupBy("digest").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                   repository_cols: tuple[str, ...] = ("source", "lang"), **options) -> DataFrame:
    """``doc_id`` and ``spans`` (see :func:`scan`; empty array without any) per input row.

    Null texts are empty; a null owner or repository part counts as none (a repository with a null part is built from
    the others). Repeated rows give repeated results, rows without an id keep their null. An empty table gives an empty
    result; columns other than those named are ignored.
    """
    c.prepare(docs.sparkSession)
    owner, repository = F.col(owner_col), F.concat_ws("/", *[F.col(x) for x in repository_cols])
    spans = c.written(scan(docs, owner, repository, text_col, **options), "spans")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "digest", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source",
           repository_cols: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]", **options) -> DataFrame:
    """All columns of ``docs``, with ``mark`` in place of every run of overlapping or touching spans of ``text_col``.

    Texts without a span, null and empty ones included, stay as they are. Repeated rows and rows without an id are masked
    like others. An empty table gives an empty result. Columns of any name pass through.
    """
    c.prepare(docs.sparkSession)
    digest, cuts = c.free_name(docs, "digest"), c.free_name(docs, "cuts")
    owner, repository = F.col(owner_col), F.concat_ws("/", *[F.col(x) for x in repository_cols])
    spans = scan(docs, owner, repository, text_col, **options).select("digest", F.explode("spans").alias("s")) \
        .select("digest", "s.start", "s.stop")
    order = Window.partitionBy("digest").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
                 .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                 .groupBy("digest", "run").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
                 .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(cuts)))
    runs = c.written(runs, "cuts").withColumnRenamed("digest", digest)
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(runs, digest, "left")

    def piece(cut, i):
        at = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(cuts, i - 1)["b"])
        return F.concat(F.substring(F.col(text_col), (at + 1).cast("int"), (cut["a"] - at).cast("int")), F.lit(mark))

    tail = F.expr(f"substring(`{text_col}`, CAST(element_at({cuts}, -1).b + 1 AS INT))")
    masked = F.concat(F.array_join(F.transform(cuts, piece), ""), tail)
    return rows.withColumn(text_col, F.when(F.col(cuts).isNotNull(), masked).otherwise(F.col(text_col))) \
               .select(*docs.columns)
