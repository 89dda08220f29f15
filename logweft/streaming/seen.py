"""Lines a reader has not seen yet, with positions that move while the stream runs.

State is kept per file (``transformWithState``, RocksDB): the seen position, the
number of pending lines, and their offsets in blocks, one a micro-batch. A
batch of lines adds a block; a "seen" event from the control stream drops whole
blocks and trims one. So a batch of lines does not read the blocks, and an
event reads only what is still pending.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeenLines(StatefulProcessor):
    """Rows ``file, byte_offset`` (a line) or ``file, seen`` (an event) of one file to ``file, pending_lines, seen``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "seen long, pending long")
        self.blocks = handle.getListState("blocks", "offsets binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, pending = self.place.get() if self.place.exists() else (0, 0)
        told, lines = [seen], []
        for frame in rows:
            told += frame["seen"].dropna().astype("int64").tolist()
            lines.append(frame["byte_offset"].dropna().to_numpy().astype("<i8"))
        now = max(told)
        new = np.sort(np.concatenate(lines)) if lines else np.zeros(0, "<i8")
        new = new[new >= now]
        if now > seen and pending:
            kept = []
            for (block,) in self.blocks.get():
                offsets = np.frombuffer(block, "<i8")
                left = offsets[offsets >= now]
                pending -= len(offsets) - len(left)
                if len(left):
                    kept.append((left.tobytes(),))
            self.blocks.clear()
            if kept:
                self.blocks.put(kept)
        if len(new):
            self.blocks.appendValue((new.tobytes(),))
        pending += len(new)
        self.place.update((now, pending))
        yield pd.DataFrame({"file": [key[0]], "pending_lines": [pending], "seen": [now]})

    def close(self) -> None:
        pass


def pending_after_seen(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Running ``file, pending_lines, seen`` of every file that a batch touches
    (update mode).

    ``lines`` is a stream with ``file, byte_offset``; ``events`` one with
    ``file, seen``: all lines that start before that position are seen. The
    position only moves forward, whatever order events arrive in, and holds for
    lines that come later, too. Events of files without lines are kept for
    them; rows without a file are left out.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)      # transformWithState needs it
    if "error" in lines.columns:
        lines = lines.filter(F.col("error").isNull())       # error reports are no lines
    none = F.lit(None).cast("long")
    rows = lines.select("file", F.col("byte_offset").cast("long").alias("byte_offset"), none.alias("seen")).unionByName(
        events.select("file", none.alias("byte_offset"), F.col("seen").cast("long").alias("seen"))).filter("file IS NOT NULL")
    return rows.groupBy("file").transformWithStateInPandas(
        SeenLines(), "file string, pending_lines long, seen long", "Update", "None")
