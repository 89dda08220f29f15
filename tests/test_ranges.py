"""Range reads: cuts anywhere, gzip members, files that break, byte-order marks."""

import bz2
import gzip
import os
import random

import pytest

from logweft.sources import ranges
from logweft.sources.files import read_logs


def write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def expected(data):
    """(offset, line) of every line of a text, its byte-order mark counted but not shown."""
    out, at = [], 0
    if data.startswith(b"\xef\xbb\xbf"):
        data, extra = data[3:], 3
    else:
        extra = 0
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    for k, line in enumerate(lines):
        out.append((at, line))
        at += len(line) + 1 + (extra if k == 0 else 0)
    return out


def owned(uri, size, cuts):
    out = []
    for a, b in zip(cuts, [*cuts[1:], size]):
        for offset, lines in ranges.line_runs(ranges.Range(uri, size, a, b)):
            for line in lines:
                out.append((offset, line))
                offset += len(line) + 1
    return out


def random_text(rng):
    parts = [b"\n", b"\n", b"a", b"bc\r", b"\xff", "é".encode(), b"x" * 9]
    return (b"\xef\xbb\xbf" if rng.random() < 0.3 else b"") + b"".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_a_line_belongs_to_one_range_wherever_the_cuts_are(tmpdir_path, monkeypatch):
    rng = random.Random(2)
    for k in range(400):
        monkeypatch.setattr(ranges, "_READ", rng.choice([1, 2, 5, 1 << 20]))
        data = random_text(rng)
        path = write(tmpdir_path, f"p{k}", data)
        cuts = [0, *sorted(rng.sample(range(1, len(data)), min(3, len(data) - 1)))] if len(data) > 1 else [0]
        if data.startswith(b"\xef\xbb\xbf"):
            cuts = [0, *[x for x in cuts if x > 3]]
        assert owned("file:" + path, len(data), cuts) == expected(data), (data, cuts)


def test_gzip_members_are_read_apart(tmpdir_path, monkeypatch):
    rng = random.Random(4)
    for k in range(150):
        monkeypatch.setattr(ranges, "_FEED", rng.choice([1, 7, 1 << 14]))
        parts = [random_text(rng).replace(b"\xef\xbb\xbf", b"") for _ in range(rng.randint(1, 5))]
        packed = [gzip.compress(p) + b"\0" * rng.choice([0, 0, 3]) for p in parts]
        starts = [sum(map(len, packed[:i])) for i in range(len(packed))]
        data = b"".join(packed)
        path = write(tmpdir_path, f"m{k}.gz", data)
        cuts = sorted({0, *rng.sample(starts, rng.randint(1, len(starts)))})
        lines = [line for _, line in owned("file:" + path, len(data), cuts)]
        assert lines == [line for _, line in expected(b"".join(parts))]
        for a in range(1, len(data), max(1, len(data) // 7)):
            found = ranges._first_member("file:" + path, a, len(data))
            assert found == min((s for s in starts if s >= a), default=None)


def test_a_run_that_no_member_ends_is_an_error(tmpdir_path):
    data = gzip.compress(b"one\n") + gzip.compress(b"two\n")
    path = write(tmpdir_path, "w.gz", data)
    with pytest.raises(ranges.Broken, match="no gzip member begins"):
        list(ranges.line_runs(ranges.Range("file:" + path, len(data), 0, 9)))


def test_broken_files_are_named_after_their_good_lines(spark, tmpdir_path):
    rng = random.Random(6)
    lines = [f"line {k} {rng.random()}".encode() for k in range(20_000)]
    text = b"\n".join(lines) + b"\n"
    packed, blocks = gzip.compress(text), bz2.compress(text, 1)
    damaged = bytearray(packed)
    damaged[len(packed) // 2] ^= 0xFF
    write(tmpdir_path, "a-good.log", b"fine 1\nfine 2\n")
    cut = write(tmpdir_path, "b-cut.log.gz", packed[:len(packed) // 2])
    write(tmpdir_path, "c-cut.log.bz2", blocks[:len(blocks) // 2])
    write(tmpdir_path, "d-damaged.log.gz", bytes(damaged))
    write(tmpdir_path, "e-garbage.log.gz", b"\x1f\x8b\x08\x00 this is not gzip data")
    write(tmpdir_path, "f-good.log.gz", packed)
    found = read_logs(spark, [tmpdir_path, tmpdir_path + "/none.log"], on_missing="report")
    got = {}
    for r in found.lines.select("file_name", "line_no", "raw").collect():
        got.setdefault(r.file_name, {})[r.line_no] = r.raw.encode()
    good = {name: [x[k] for k in range(len(x))] for name, x in got.items()}
    assert good["a-good.log"] == [b"fine 1", b"fine 2"] and good["f-good.log.gz"] == lines
    errors = {os.path.basename(r.path): r for r in found.errors.collect()}
    assert set(errors) == {"b-cut.log.gz", "c-cut.log.bz2", "d-damaged.log.gz", "e-garbage.log.gz", "none.log"}
    # all that a decompressor gives up to the break, compared with reading byte by byte
    import zlib
    stream = zlib.decompressobj(31)
    whole = b"".join(stream.decompress(packed[k:k + 1]) for k in range(len(packed) // 2))
    assert good["b-cut.log.gz"] == whole.split(b"\n")[:-1]
    assert errors["b-cut.log.gz"].rest.encode() == whole.split(b"\n")[-1] and errors["b-cut.log.gz"].position == len(packed) // 2
    assert "inside a gzip member" in errors["b-cut.log.gz"].error
    n = len(good["c-cut.log.bz2"])
    assert 0 < n < 20_000 and good["c-cut.log.bz2"] == lines[:n]
    assert good["d-damaged.log.gz"][:5000] == lines[:5000] and errors["d-damaged.log.gz"].position > len(packed) // 2
    assert "e-garbage.log.gz" not in good and "none.log" not in good
    with pytest.raises(Exception, match="inside a gzip member"):
        read_logs(spark, cut, offsets=True).lines.collect()


def test_long_gzip_files_are_read_by_many_tasks(spark, tmpdir_path, monkeypatch):
    rng = random.Random(7)
    members = ["".join(f"m{m} l{k} {rng.random()}\n" for k in range(300)) for m in range(100)]
    members[5] = members[5][:-1]                             # a line that goes on in the next member
    text = "".join(members)
    path = write(tmpdir_path, "many.log.gz", b"".join(gzip.compress(m.encode()) for m in members))
    monkeypatch.setattr(ranges, "CHUNK_BYTES", 1)            # read_ranges: no two ranges share a task
    plan = ranges.plan_files(spark, ["file:" + path], 12_000)
    assert len(plan) > 20
    rows = ranges.with_positions(ranges.read_ranges(spark, plan, chunk=1))
    assert rows.rdd.getNumPartitions() == len(plan)
    got = sorted((r.line_no, r.byte_offset, bytes(r.raw)) for r in rows.collect())
    assert got == [(k, at, line) for k, (at, line) in enumerate(expected(text.encode()))]
    same = read_logs(spark, path).lines.select("line_no", "raw").collect()
    assert sorted((r.line_no, r.raw.encode()) for r in same) == [(k, line) for k, _, line in got]


def test_offsets_of_compressed_files_with_a_mark(spark, tmpdir_path):
    data = b"\xef\xbb\xbfabc\nde\nf"
    for name, packed in (("b.gz", gzip.compress(data)), ("b.bz2", bz2.compress(data)), ("b.log", data)):
        path = write(tmpdir_path, name, packed)
        rows = read_logs(spark, path, offsets=True).lines.orderBy("line_no").collect()
        assert [(r.raw, r.byte_offset) for r in rows] == [("abc", 0), ("de", 7), ("f", 10)]
