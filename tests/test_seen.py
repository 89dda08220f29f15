"""Pending lines under moving seen positions."""

import os

from logweft.streaming.seen import pending_after_seen
from logweft.streaming.streams import tail_logs


def test_seen_events_move_the_position(spark, tmpdir_path):
    a, b = (os.path.join(tmpdir_path, x) for x in ("a.log", "b.log"))
    control, ck = os.path.join(tmpdir_path, "control"), os.path.join(tmpdir_path, "ck")
    os.makedirs(control)
    for p in (a, b):
        with open(p, "w") as fh:
            fh.write("".join(f"line {k}\n" for k in range(10)))          # 7 bytes each
    found = {}

    def run():
        lines = tail_logs(spark, [a, b], starting_position="earliest")
        events = spark.readStream.schema("file string, seen long").json(control)
        query = pending_after_seen(lines, events).writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(
            lambda batch, _: found.update({os.path.basename(r.file): (r.pending_lines, r.seen) for r in batch.collect()}))
        query.trigger(availableNow=True).start().awaitTermination()

    def event(n, *rows):
        with open(os.path.join(control, f"{n}.json"), "w") as fh:
            fh.write("".join('{"file": "%s", "seen": %d}\n' % r for r in rows))

    run()
    assert found == {"a.log": (10, 0), "b.log": (10, 0)}
    event(1, (a, 21), (a, 14))                                           # out of order: the furthest counts
    run()
    assert found == {"a.log": (7, 21), "b.log": (10, 0)}
    event(2, (a, 7), (b, 70))                                            # never backwards
    with open(a, "a") as fh:
        fh.write("line x\nline y\n")
    run()
    assert found == {"a.log": (9, 21), "b.log": (0, 70)}
    event(3, (a, 77), (b, 84))                                           # ahead of the file
    run()
    with open(b, "a") as fh:
        fh.write("line p\nline q\nline r\n")                             # at 70, 77, 84
    run()
    assert found == {"a.log": (1, 77), "b.log": (1, 84)}
