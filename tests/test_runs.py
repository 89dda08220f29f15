"""Merging by zone maps against a plain sort."""

import random

from pyspark.sql import functions as F

from logweft.operators import merge, runs


def log(spark, files, partitions=3):
    """A keyed log from {file_order: [ts_key, ...]}."""
    rows = [(f"f{o}", o, i, k, "x" * 50) for o, keys in files.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "file string, file_order int, line_no bigint, ts_key bigint, raw string")
    return df.repartitionByRange(partitions, "file_order", "line_no").sortWithinPartitions("file_order", "line_no")


def want(files):
    order = sorted((k, i, o) for o, keys in files.items() for i, k in enumerate(keys))
    return {(o, i): n for n, (_, i, o) in enumerate(order)}


def got(df):
    return {(r.file_order, r.line_no): r.merged_no for r in df.collect()}


def test_random_logs_equal_a_sort(spark):
    rng = random.Random(1)
    for case in range(6):
        files = {}
        for o in range(rng.randint(1, 5)):
            start, step = rng.randint(0, 3000), rng.choice([0, 1, 5])
            keys = [start + step * i for i in range(rng.randint(1, 300))]
            if rng.random() < 0.4:                       # somewhere out of order
                at = rng.randrange(len(keys))
                keys[at] = rng.randint(0, 3000)
            files[o] = keys
        df = log(spark, files)
        if case % 2:
            df = df.orderBy(F.xxhash64("file_order", "line_no"))      # lines come in no order
        for run in (1, 7, 64):
            assert got(runs.merged_by_zones(df, run=run)) == want(files), (case, run)


def test_hot_time(spark):
    files = {0: [0] * 500 + [5], 1: [0] * 300, 2: [-1] + [0] * 100 + [9] * 50}
    assert got(runs.merged_by_zones(log(spark, files), run=32)) == want(files)


def test_rotated_logs_are_merged_without_a_shuffle_of_lines(spark, monkeypatch):
    files = {o: [o * 1000 + i for i in range(900)] for o in range(4)}
    ranked = []
    real = runs.rank_within
    monkeypatch.setattr(runs, "rank_within", lambda df, *a, **k: ranked.append(df.columns) or real(df, *a, **k))
    out = runs.merged_by_zones(log(spark, files), run=100)
    assert got(out) == want(files) and not ranked
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Join" in x]
    assert len(lines) == 1 and "broadcast" in plan
    # a file that lies over one other: its lines and the other's are ranked, by keys alone
    files[9] = [1100 + 3 * i for i in range(200)]
    counted = []
    monkeypatch.setattr(runs, "rank_within", lambda df, *a, **k: counted.append((df.columns, df.count())) or real(df, *a, **k))
    assert got(runs.merged_by_zones(log(spark, files), run=100)) == want(files)
    (columns, n), = counted
    assert columns == ["__k", "__l", "__f", "apart_before"] and 200 < n <= 200 + 700 < 3600


def test_a_run_grows_with_the_table(spark, monkeypatch):
    df = spark.range(10)
    assert runs.run_lines(df) == runs.RUN_LINES
    monkeypatch.setattr(runs, "range_partitions", lambda df: 400_000)          # 100 TB
    assert 400_000 * (256 << 20) // 100 // runs.run_lines(df) <= runs.MAX_ZONES
    empty = log(spark, {0: [1]}).limit(0)
    assert runs.merged_by_zones(empty).count() == 0
    assert merge.MERGE_KEY == ["ts_key", "line_no", "file_order"]


def test_files_that_all_overlap_are_read_once_for_keys_and_once_for_rows(spark):
    files = {o: [o + 10 * i for i in range(300)] for o in range(3)}
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = log(spark, files)
    keyed = df.mapInArrow(count, df.schema)
    out = runs.merged_by_zones(keyed, run=50)
    assert seen.value == 900                 # zone map and ranks come from the keys
    assert got(out) == want(files) and seen.value == 1800
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_few_and_many_zones_are_placed_alike(spark, monkeypatch):
    """Few zones are placed by one task, without the shuffles between range partitions; the places are the same."""
    rng = random.Random(3)
    files = {o: sorted(rng.randint(o * 500, o * 500 + 800) for _ in range(300)) for o in range(4)}
    zones = runs.written_once(runs.zone_map(log(spark, files), 16), "zone-map")
    counted = zones.count()
    few = runs._placed(zones, counted)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
    monkeypatch.setattr(runs, "ZONES_IN_TASK", 0)
    many = runs._placed(zones, counted)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == sum(-(-300 // 16) for _ in files)


def test_ranked_rows_are_read_by_column(spark):
    """Later passes over numbered rows read the columns they need; rows that Parquet cannot hold are numbered as well."""
    from logweft.operators.numbering import rank_within
    df = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("wide"), F.lit(None).alias("none"))
    ranked = rank_within(df.drop("none"), [F.desc("id")])
    plan = ranked.select("pos")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "wide" not in plan
    for rows in (ranked, rank_within(df, [F.desc("id")])):
        assert [(r.id, r.pos) for r in rows.orderBy("id").collect()] == [(i, 49 - i) for i in range(50)]


def test_few_file_names_are_ranked_by_one_task(spark):
    from logweft.sources.tables import with_file_order
    names = ["app.log.10", "app.log.2", "app.log", None, "b.1"]
    df = spark.createDataFrame([(n, i) for n in names for i in range(3)], "file string, x int")
    out = with_file_order(df)
    assert {(r.file, r.file_order) for r in out.collect()} == {
        ("app.log", 0), ("app.log.2", 1), ("app.log.10", 2), ("b.1", 3), (None, None)} and out.count() == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan       # no counts of earlier partitions to add
