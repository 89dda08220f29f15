"""Entities in log text: IP and MAC addresses, UUIDs, numbers, strings, paths.

One alternation scanned left to right: at each position the first
alternative that matches wins, and matches do not overlap. Spark runs it as
one ``regexp_extract_all`` pass per line. No match crosses a line feed, and
every alternative decides in time bounded by a constant or by what it
consumes, so a pass is linear in the line:

* a number takes its digits possessively and names, in order, all places at
  which the backtracking form could end;
* a path runs to the next ``]``; the ``[`` that no ``]`` follows are taken out
  of the regex's sight first (:func:`_without_open_brackets`);
* a string that finds no end is the last with its quote, because each quote
  that may begin a string may also end the one before.

The kind follows from the match's own shape (:func:`_kind_of`).

A line of any length is extracted in pieces (:func:`pieces_col`), so no task
holds all matches of one; a line that comes in pieces is not put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Entity kinds and their patterns, in the order they are tried.
# (?U): \w, \d, \b
# follow Unicode as Python's str patterns do; (?d): only \n ends a line.
ENTITY_PATTERNS: list[tuple[str, str]] = [
    ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("ipv6", r"(?:[A-Fa-f0-9]{1,4}::?){1,7}[A-Fa-f0-9]{1,4}"),
    ("eui64", r"(?:[0-9A-Fa-f]{1,2}-){7}[0-9A-Fa-f]{1,2}|(?:[0-9A-Fa-f]{1,2}:){7}[0-9A-Fa-f]{1,2}"
              r"|(?:[0-9A-Fa-f]{4}\.){3}[0-9A-Fa-f]{4}"),
    ("eui48", r"(?:[0-9A-Fa-f]{1,2}-){5}[0-9A-Fa-f]{1,2}|(?:[0-9A-Fa-f]{1,2}:){5}[0-9A-Fa-f]{1,2}"
              r"|(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}"),
    ("uuid", r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}"),
    ("bool_true", r"\bTrue\b"),
    ("bool_false", r"\bFalse\b"),
    ("none", r"\bNone\b"),
    ("number", r"(?<!\w)-?[0-9]++(?:\.[0-9]*+e[-+]?\d++\b|\.[0-9]*+\b|\.\b|e[-+]?\d++\b|\b)|0x[0-9a-fA-F]*+"),
    ("str", r"(?<![\\\w])b?(?:'''.*?(?<!\\)'''|'.*?(?<!\\)'|\"\"\".*?(?<!\\)\"\"\"|\".*?(?<!\\)\")"),
    ("path", r"\[[^\]]*+\]"),
]
ENTITY_KINDS = [k for k, _ in ENTITY_PATTERNS]

# Speed only: look-aheads that every match of the kind satisfies anyway (the
# separator that must follow the first hex digits). Ordinary words made of
# the letters a-f then fail at once instead of backtracking through groups.
_GUARDS = {
    "ipv6": r"(?=[A-Fa-f0-9]{1,4}+:)",
    "eui64": r"(?=[0-9A-Fa-f]{1,2}+[-:]|[0-9A-Fa-f]{4}\.)",
    "eui48": r"(?=[0-9A-Fa-f]{1,2}+[-:]|[0-9A-Fa-f]{4}\.)",
    "uuid": r"(?=[a-fA-F0-9]{8}-)",
}
# Any match starts with one of these characters.
_FIRST = r"(?=[-0-9A-Fa-fTFNb'\"\[])"


# The address kinds (the first five) all need '.', ':' or '-' within their
# first nine characters; one shared look-ahead skips all five at once.
_ADDRESS_KINDS = ("ipv4", "ipv6", "eui64", "eui48", "uuid")
_ADDRESS_GUARD = r"(?=[0-9A-Fa-f]{1,8}+[-:.])"


def entity_regex() -> str:
    parts = [f"{_GUARDS.get(kind, '')}(?:{rx})" for kind, rx in ENTITY_PATTERNS]
    n = len(_ADDRESS_KINDS)
    assert [k for k, _ in ENTITY_PATTERNS[:n]] == list(_ADDRESS_KINDS)
    address = _ADDRESS_GUARD + "(?:" + "|".join(parts[:n]) + ")"
    return "(?dU)" + _FIRST + "(?:" + "|".join([address] + parts[n:]) + ")"


ENTITY_RX = entity_regex()

# Stand for a "[" that nothing closes: noncharacters, neither letters nor
# digits to a regex. The first that the text does not hold is taken.
_HIDDEN = ("\uffff", "\ufdd0")


def _without_open_brackets(c: Column, hidden: str) -> Column:
    """The text with ``hidden`` for every ``[`` that no ``]`` follows."""
    tail = F.substring_index(c, "]", -1)
    return F.concat(F.left(c, F.length(c) - F.length(tail)), F.replace(tail, F.lit("["), F.lit(hidden)))


def _matches(c: Column) -> Column:
    """All matches in a text without line feeds."""
    found = lambda t: F.regexp_extract_all(t, F.lit(ENTITY_RX), 0)
    out = F.when(~F.substring_index(c, "]", -1).contains("["), found(c))
    for hidden in _HIDDEN:
        shown = F.transform(found(_without_open_brackets(c, hidden)), lambda m: F.replace(m, F.lit(hidden), F.lit("[")))
        out = out.when(~c.contains(hidden), shown)
    return out.otherwise(found(c))


def _kind_of(match: Column) -> Column:
    """Kind of one match by its shape.

    A path begins with a bracket and a string with a quote (or ``b`` and one),
    the three words are themselves, and a colon is only left to ``ipv6`` (it
    comes before the colon forms of the MAC kinds and takes all of them).
    Numbers have up to two dashes and one dot; the other kinds have more, in
    numbers of their own, but for four groups of four digits (19 characters),
    which ``ipv4`` (up to 15) also separates by three dots.
    """
    first = F.left(match, F.lit(1))
    count = lambda mark: F.length(match) - F.length(F.replace(match, F.lit(mark), F.lit("")))
    dashes, dots = count("-"), count(".")
    return (F.when(first == "[", "path")
             .when(first.isin("'", '"') | F.left(match, F.lit(2)).isin("b'", 'b"'), "str")
             .when(match == "True", "bool_true").when(match == "False", "bool_false").when(match == "None", "none")
             .when(F.instr(match, ":") > 0, "ipv6")
             .when(dashes == 7, "eui64").when(dashes == 5, "eui48").when(dashes == 4, "uuid")
             .when((dots == 3) & (F.length(match) == 19), "eui64").when(dots == 3, "ipv4").when(dots == 2, "eui48")
             .otherwise("number"))


def entities_col(col: Column | str = "line") -> Column:
    """ARRAY<STRUCT<kind STRING, value STRING>> of the entities in the text.

    One regex pass finds all matches of a line; the kind is read off each.
    """
    c = F.col(col) if isinstance(col, str) else col
    by_line = F.flatten(F.transform(F.split(c, "\n"), _matches))
    return F.transform(F.when(~c.contains("\n"), _matches(c)).otherwise(by_line),
                       lambda m: F.struct(_kind_of(m).alias("kind"), m.alias("value")))


# A longer line is cut, each time before the first blank behind so many characters.
PIECE_CHARS = 1 << 16

# What may be taken off a piece to see that no string or path is open at its
# end: strings and paths that hold no other mark, and quotes that can begin no
# string because of the character before them.
_SETTLED = (r"""(?U)(?=['"\[])(?:(?<![\\\w])'[^'"\[\]\\\n]*+'|(?<![\\\w])"[^'"\[\]\\\n]*+"|\[[^\]\['"\n]*+\]"""
            r"""|(?<=[\\\w&&[^b]])['"]|(?<=\wb)['"])""")


def _settled(text: Column) -> Column:
    """Whether no match can go on behind the text, which is cut before a blank
    (a sufficient test: only strings and paths hold blanks)."""
    # one look at each: a fold keeps no common values
    return ~(text.rlike("'''|\"\"\"") | F.regexp_replace(text, _SETTLED, "").rlike("['\"\\[]"))


def pieces_col(c: Column, chars: int) -> Column:
    """ARRAY<STRING>: a line without line feeds cut so that the pieces' matches,
    one piece after the other, are those of the line. Cuts that a string or
    path may cross are left out; what is open is looked at again when it has
    doubled, so the time is linear."""
    parts = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{chars}}}[^ ]*+"), F.lit(0))
    none = F.array().cast("array<string>")

    def state(done, held, size, seen):
        return F.struct(done.alias("done"), held.alias("held"), size.alias("size"), seen.alias("seen"))

    def step(acc, part):
        held, size = F.concat(acc.held, F.array(part)), acc.size + F.octet_length(part)
        due, zero = size >= 2 * acc.seen, F.lit(0).cast("bigint")
        text = F.array_join(held, "")
        return (F.when(due & _settled(text), state(F.concat(acc.done, F.array(text)), none, zero, zero))
                 .otherwise(state(acc.done, held, size, F.when(due, size).otherwise(acc.seen))))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(parts, state(none, none, zero, zero), step, lambda acc: F.when(F.size(acc.held) == 0, acc.done).otherwise(
        F.concat(acc.done, F.array(F.array_join(acc.held, "")))))


def _exploded(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each of ``__found``. Outer: for an inner one the planner puts a
    filter on its size below, and with that finds all of it twice."""
    return found.select(*keep, F.posexplode_outer("__found").alias("pos", "e")).filter(F.col("e").isNotNull())


def _on(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """An inner join by keys that may be NULL."""
    other = right.withColumnsRenamed({k: f"__on{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__on{i}")) for i, k in enumerate(keys)]
    return left.join(other, same).drop(*[f"__on{i}" for i in range(len(keys))])


def _clean_pieces(df: DataFrame, keep: tuple[str, ...], chars: int) -> DataFrame:
    """Lines in pieces cut anywhere (``keep``, ``__part``, ``__text``), cut anew
    as :func:`pieces_col` cuts (``keep``, ``__piece``, ``__text``).

    A new piece begins at the first blank of a part that lies in another run of
    ``chars`` characters than that of the part with a blank before, and inside
    a longer part after so many characters; where it begins follows from a few
    numbers of each part. Pieces at whose end a match may be open are then
    joined in pairs with those behind them, until none is.
    """
    from pyspark.sql import Window
    from logweft.operators.numbering import LONG_ROWS_BYTES, small_table, written_once
    text = F.col("__text")
    head = F.substring_index(text, " ", 1)              # all of a text without a blank
    rest = F.substr(text, F.length(head) + F.lit(1))
    cut = F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{chars}}}[^ ]*+"), F.lit(0))
    number = F.when(rest == "", 0).when(F.length(rest) <= chars, 1).otherwise(F.size(cut))
    line = Window.partitionBy(*keep).orderBy("__part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.floor(c / chars)
    facts = df.select(*keep, "__part", F.length(text).alias("__chars"), F.length(head).alias("__head"), number.alias("__number"))
    facts = facts.withColumn("__blank", F.when(F.col("__number") > 0, F.coalesce(F.sum("__chars").over(before), F.lit(0)) + F.col("__head")))
    facts = facts.withColumn("__opens", F.coalesce(run(F.col("__blank")) > run(F.coalesce(F.max("__blank").over(before), F.lit(-1))), F.lit(False)))
    begun = F.greatest(F.col("__number") - F.when(F.col("__opens"), 0).otherwise(1), F.lit(0))
    facts = facts.withColumn("__begun", begun).withColumn("__so_far", F.coalesce(F.sum("__begun").over(before), F.lit(0)))
    facts = small_table(facts.select(*keep, "__part", "__opens", "__so_far"), 48 + 256 * len(keep))
    at = _on(df, facts, (*keep, "__part")).select(*keep, "__part", "__opens", "__so_far", F.posexplode(F.concat(F.array(head), cut)).alias("__at", "__text"))
    piece = F.col("__so_far") + F.greatest(F.col("__at") - F.when(F.col("__opens"), 0).otherwise(1), F.lit(0))
    pieces = _put_together(at.filter(text != "").withColumn("__piece", piece), (*keep, "__piece"), ("__part", "__at"))
    pieces = written_once(pieces.withColumn("__open", ~_settled(text)), "pieces", LONG_ROWS_BYTES)
    of = _closed(pieces, keep)
    if of is None:
        return pieces.drop("__open")
    of = _on(pieces.drop("__open"), of, (*keep, "__piece"))
    joined = _put_together(of.filter("__joined"), (*keep, "__first"), ("__piece",)).withColumnRenamed("__first", "__piece")
    return of.filter("NOT __joined").select(*keep, "__piece", "__text").unionByName(joined)


def _put_together(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The texts of the same keys as one, in order."""
    held = F.sort_array(F.collect_list(F.struct(*order, "__text")))
    return df.groupBy(*keys).agg(held.alias("__held")).select(*keys, F.array_join("__held.__text", "").alias("__text"))


def _closed(pieces: DataFrame, keep: tuple[str, ...]) -> DataFrame | None:
    """The first of the pieces that each one is joined with, so that no match
    is open at their ends (``keep``, ``__piece``, ``__first``, ``__joined``);
    None if all stay as they are.

    Each round joins the first, third, ... of neighbouring open ones with the
    next, so what is joined at most doubles; only the texts of what has grown
    are read again.
    """
    from pyspark.sql import Window
    from logweft.operators.numbering import written_once
    heads = pieces.select(*keep, F.col("__piece").alias("__first"), "__open")
    of = pieces.select(*keep, "__piece", F.col("__piece").alias("__first"))
    line = Window.partitionBy(*keep).orderBy("__first")
    grown = False
    while True:
        # the end of a line closes all that is open
        heads = written_once(heads.withColumn("__open", F.col("__open") & F.lead("__first").over(line).isNotNull()), "heads")
        if heads.filter("__open").isEmpty():
            break
        closed = F.coalesce(F.sum((~F.col("__open")).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        second = F.row_number().over(Window.partitionBy(*keep, "__closed").orderBy("__first")) % 2 == 0
        to = heads.withColumn("__closed", closed).withColumn("__second", second)
        to = to.withColumn("__to", F.when(F.col("__second"), F.lag("__first").over(line)).otherwise(F.col("__first")))
        to = to.withColumn("__grows", F.count(F.lit(1)).over(Window.partitionBy(*keep, "__to")) > 1)
        to = written_once(to.select(*keep, "__first", "__to", "__grows", "__open"), "joins")
        of = written_once(_on(of, to.select(*keep, "__first", "__to", "__grows"), (*keep, "__first")).select(
            *keep, "__piece", F.col("__to").alias("__first"), "__grows"), "pieces-of")
        texts = _on(pieces.drop("__open"), of.filter("__grows").drop("__grows"), (*keep, "__piece"))
        again = _put_together(texts, (*keep, "__first"), ("__piece",)).select(*keep, "__first", (~_settled(F.col("__text"))).alias("__open"))
        heads = to.filter("NOT __grows").select(*keep, "__first", "__open").unionByName(again)
        of, grown = of.drop("__grows"), True
    if not grown:
        return None
    return of.withColumn("__joined", F.count(F.lit(1)).over(Window.partitionBy(*keep, "__first")) > 1)


def extract_entities(df: DataFrame, col: str = "line",
                     keep: tuple[str, ...] = ("file", "line_no"), piece_col: str | None = None) -> DataFrame:
    """Entity table ``(file, line_no, pos, kind, value)``; ``pos`` is the
    0-based index of the match in its line. Pieces of long lines are spread
    over the tasks.

    With ``piece_col`` a row is a piece of a line, which ``keep`` names: cut
    anywhere between characters, the pieces follow one another by that column
    (:func:`logweft.sources.tables.logs_from_table`). The entities are those of
    the line put together, which no task does. Runs jobs at call time."""
    from pyspark.sql import Window
    from logweft.operators.numbering import range_partitions
    of = [F.col("pos").cast("int").alias("pos"), F.col("e.kind").alias("kind"), F.col("e.value").alias("value")]
    c = F.col(col)
    if piece_col is not None:
        pieces = _clean_pieces(df.select(*keep, F.col(piece_col).alias("__part"), F.coalesce(c, F.lit("")).alias("__text")), keep, PIECE_CHARS)
        found = pieces.select(*keep, "__piece", entities_col("__text").alias("__found"))
        counts = Window.partitionBy(*keep).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("__before", F.coalesce(F.sum(F.size("__found")).over(counts), F.lit(0)))
        return _exploded(found, (*keep, "__before")).withColumn("pos", F.col("pos") + F.col("__before")).select(*keep, *of)
    long = F.coalesce((F.length(c) > PIECE_CHARS) & (~c.contains("\n")), F.lit(False))
    whole = _exploded(df.filter(~long).select(*keep, entities_col(col).alias("__found")), keep).select(*keep, *of)
    lines = df.filter(long).select(*keep, c.alias("__text"), F.monotonically_increasing_id().alias("__line"))
    pieces = lines.select(*keep, "__line", F.posexplode(pieces_col(F.col("__text"), PIECE_CHARS)).alias("__piece", "__text"))
    # a few source bytes may be long lines: not fewer tasks than the session asks for
    parts = max(range_partitions(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = pieces.repartition(parts, "__line", "__piece").select(
        *keep, "__line", "__piece", entities_col("__text").alias("__found"))
    before = Window.partitionBy("__line").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("__before", F.coalesce(F.sum(F.size("__found")).over(before), F.lit(0)))
    cut = _exploded(found, (*keep, "__before")).withColumn("pos", F.col("pos") + F.col("__before")).select(*keep, *of)
    return whole.unionByName(cut)


def entity_counts(entities: DataFrame) -> DataFrame:
    """Matches and distinct values per kind."""
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("matches"),
                                        F.countDistinct("value").alias("distinct_values"))


def top_entities(entities: DataFrame, kind: str | None = None, k: int = 10,
                 buckets: int = 64) -> DataFrame:
    """The ``k`` most frequent values of one kind, or of every kind
    (ties: smaller value first).

    Two-level top-k: first inside (kind, hash bucket of the value), so no
    window partition holds more than a bucket's share of a kind's distinct
    values, then over the at most ``k * buckets`` survivors of each kind.
    """
    from pyspark.sql import Window
    src = entities if kind is None else entities.filter(F.col("kind") == kind)
    counted = src.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    rank_order = [F.desc("occurrences"), F.col("value")]
    local = Window.partitionBy("kind", F.pmod(F.hash("value"), F.lit(buckets))).orderBy(*rank_order)
    survivors = counted.withColumn("__r", F.row_number().over(local)).filter(F.col("__r") <= k)
    overall = Window.partitionBy("kind").orderBy(*rank_order)
    return (survivors.withColumn("rank", F.row_number().over(overall))
                     .filter(F.col("rank") <= k).drop("__r"))
