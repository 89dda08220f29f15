"""Sharding by rendezvous (highest random weight) hashing.

Each record key meets each shard in a hash that is uniform in (0, 1); with weight w the shard's score is -ln(u) / w and
the least score has the key, so a shard holds keys in proportion to its weight. A score depends on the key, the shard's
number and its weight alone: a new shard takes keys only into itself, a shard that goes gives up only its own keys, and
a changed weight moves keys only to or from that shard. There is no table of places to keep: any program can find a
record's shard with MD5 and a logarithm.

Everything is column expressions; the shard of a row needs no shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm import common as c
from logweft.llm.ranks import gapless

#: Bits of an MD5 that make the uniform number (all that a double holds, less one).
HASH_DIGITS = 13
#: Bytes that a record counts beside its text.
RECORD_BYTES = 16


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, HASH_DIGITS)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** HASH_DIGITS))
    return -F.log(uniform) / weight


def _best(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the shard that has the key; of equal scores the smaller number."""
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w])
    return F.array_min(F.transform(slots, lambda s: F.struct(_score(key, s["i"], s["w"]).alias("score"), s["i"].alias("shard"))))


def stable_key(key: Column) -> Column:
    """The key's text; a null key has one of its own that no text has."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number (0 ..) of the shard that has ``key``; a shard of weight 0 has none. Null keys share one shard."""
    return _best(stable_key(key), weights)["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], added: float | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    ``size`` is the text's UTF-8 bytes (null: none) and ``RECORD_BYTES``; ``text_crc32`` its checksum (null as empty).
    ``slot`` counts the rows of a shard from 0 by id (null first), size and checksum, without gaps. ``grown_shard`` is
    the shard once one more of weight ``added`` (default: the mean weight) is there.

    Rows that repeat an id go to one shard, each with a slot of its own; rows without an id go to one shard; an empty
    table gives an empty result; other columns are ignored. The law looks at ids only, so equal texts with different ids
    may be apart. A hot shard or id spans many range partitions when slots are dealt (``ranks.gapless``).
    """
    c.prepare(docs.sparkSession)
    added = sum(weights) / len(weights) if added is None else added
    key, text = stable_key(F.col(id_col)), F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                       _best(key, weights).alias("old"),
                       _score(key, F.lit(len(weights)), F.lit(float(added))).alias("new") if added else F.lit(None).alias("new"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("old.shard").alias("shard"),
                       F.when(F.col("new") < F.col("old.score"), F.lit(len(weights))).otherwise(F.col("old.shard"))
                       .alias("grown_shard"))
    placed = gapless(c.written(rows, "sharded"), ["shard"], ["doc_id", "size", "text_crc32", "grown_shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def moved(docs: DataFrame, old: Sequence[float], new: Sequence[float], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose shard differs between two lists of weights, with ``old_shard`` and ``new_shard`` (these
    replace columns of such names)."""
    c.prepare(docs.sparkSession)
    return (docs.withColumns({"old_shard": shard_of(F.col(id_col), old), "new_shard": shard_of(F.col(id_col), new)})
                .filter("old_shard <> new_shard"))


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, files_per_shard: int = 1, id_col: str = "doc_id") -> None:
    """Writes whole rows under ``path`` as folders ``shard=<n>``. A shard is dealt to ``files_per_shard`` tasks by a hash
    of the row's columns, so a hot shard or id is no single task's. An input column ``shard`` is replaced."""
    c.prepare(docs.sparkSession)
    rows = docs.withColumn("shard", shard_of(F.col(id_col), weights))
    deal = F.pmod(F.xxhash64(*[x for x in docs.columns if x != "shard"]), F.lit(files_per_shard))
    rows.repartition(F.col("shard"), deal).write.partitionBy("shard").parquet(path)
