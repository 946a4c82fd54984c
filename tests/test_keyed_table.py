import random

import pytest
from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sources import keyed_table, sinks
from newsloom.sources.keyed_table import ConcurrentMerge, KeyedTable

ROWS = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "y"), (5, "e", None), (6, "f", ""), (None, "n", "x")]
DDL = "id long, title string, cat string"


def table_of(spark, rows=ROWS, slots=4, by="cat"):
    return KeyedTable.create(spark.createDataFrame(rows, DDL), scratch_path(spark, "keyed"), "id", slots, by)


def content(table, **how):
    return sorted((tuple(r) for r in table.rows(**how).collect()), key=str)


def same(found, rows):
    assert found == sorted(rows, key=str)


def test_rows_come_back(spark):
    table = table_of(spark)
    same(content(table), ROWS)
    same(content(table, values=["x"]), [r for r in ROWS if r[2] == "x"])
    same(content(table, values=[None, ""]), [r for r in ROWS if not r[2]])


def test_moved_rows_leave_their_partition(spark):
    """Row 1 moves to a partition that has rows, row 5 out of the null one, row 6 to a new one; twice."""
    table = table_of(spark)
    moves = spark.createDataFrame([(1, "y"), (5, "z"), (6, "w"), (99, "q"), (None, "q")], "id long, cat string")
    for _ in range(2):
        table.update(moves)
    same(content(table), [(1, "a", "y"), (5, "e", "z"), (6, "f", "w"), *[r for r in ROWS if r[0] not in (1, 5, 6)]])
    same(content(table, values=["x"]), [(2, "b", "x"), (None, "n", "x")])
    assert content(table, values=[None]) == []


def test_repeated_keys_are_one_update(spark):
    table = table_of(spark)
    table.update(spark.createDataFrame([(1, "m"), (1, "z"), (1, None)], "id long, title string"))
    assert content(table, values=["x"])[0] == (1, "z", "x")
    assert len(content(table)) == len(ROWS)
    table.update(spark.createDataFrame([(1, "m", 2), (1, "z", 1)], "id long, title string, v int").select("id", "title"),
                 newest=[F.asc("title")])
    assert (1, "m", "x") in content(table)


def test_upsert_takes_the_newer_version(spark):
    table = table_of(spark)
    incoming = [(2, "A", "x"), (3, "z", "y"), (7, "new", None), (None, "n2", None)]
    table.upsert(spark.createDataFrame(incoming, DDL), "title")
    same(content(table), [(3, "z", "y"), (7, "new", None), (None, "n2", None), *[r for r in ROWS if r[0] != 3]])


def test_only_touched_slots_are_written_and_old_files_go(spark):
    rows = [(i, f"t{i}", f"c{i % 3}") for i in range(200)]
    table = table_of(spark, rows, slots=16)
    before = table.state()
    after = table.update(spark.createDataFrame([(7, "new")], "id long, title string"))
    changed = [a for a, b in zip(after.slots, before.slots, strict=True) if a != b]
    assert len(changed) == 1
    assert table.vacuum() == 0  # the first generation still holds the other slots
    table.upsert(spark.createDataFrame(rows, DDL))
    assert table.vacuum() == 2
    same(content(table), rows)


def test_stored_rows_are_not_shuffled(spark):
    """One exchange in the whole merge: that of the incoming rows."""
    table = table_of(spark, [(i, f"t{i}", "c") for i in range(500)], slots=8)
    state, name = table.state(), "keyed_plan_test"
    stored = table._slots(state, list(range(8)), name)
    incoming = spark.createDataFrame([(i, "n") for i in range(400)], "id long, title string").repartition(8, "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = table._merged(state, stored, incoming, False, None)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")


def test_reading_prunes_to_current_files(spark):
    table = table_of(spark, [(i, f"t{i}", f"c{i % 3}") for i in range(100)], slots=8)
    table.update(spark.createDataFrame([(i, "n") for i in range(100)], "id long, title string"))
    read = {f.partition(f"{keyed_table.GENERATION}=")[2][:32] for f in table.rows().inputFiles()}
    plan = table.rows(values=["c1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and keyed_table.PART in plan
    assert len(content(table, values=["c1"])) == 33 and read


def test_a_dead_merge_leaves_nothing_and_runs_again(spark, monkeypatch):
    table = table_of(spark)
    updates = spark.createDataFrame([(1, "new")], "id long, title string")
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.update(updates)
    same(content(table), ROWS)
    table.update(updates)
    assert (1, "new", "x") in content(table)
    assert table.vacuum() == 1  # what the dead merge wrote


def test_of_two_merges_at_once_one_fails(spark):
    table = table_of(spark)
    stale = table.state()
    table.update(spark.createDataFrame([(1, "first")], "id long, title string"))
    with pytest.raises(ConcurrentMerge):
        table._merge(stale, spark.createDataFrame([(2, "second")], "id long, title string"), False, None)
    assert (1, "first", "x") in content(table) and (2, "b", "x") in content(table)


def test_odd_tables(spark):
    empty = table_of(spark, [])
    assert content(empty) == []
    empty.update(spark.createDataFrame([(1, "x")], "id long, title string"))
    assert content(empty) == []
    empty.upsert(spark.createDataFrame([(1, "x", None)], DDL))
    assert content(empty) == [(1, "x", None)]
    with pytest.raises(ValueError):
        empty.update(spark.createDataFrame([(1, 2)], "id long, other int"))
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark.createDataFrame([], DDL), empty.path)
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, scratch_path(spark, "nothing")).rows()


def test_partition_names_with_odd_letters(spark):
    rows = [(i, "t", c) for i, c in enumerate(["a b", "국회/정당", "x=y", "50%", "it's", "null", None, "__HIVE", "a\\b"])]
    table = table_of(spark, rows)
    table.update(spark.createDataFrame([(i, "new") for i in range(9)], "id long, title string"))
    same(content(table), [(i, "new", c) for i, _, c in rows])
    for i, _, c in rows:
        assert content(table, values=[c]) == [(i, "new", c)]


def test_random_merges_equal_a_dictionary(spark):
    rng = random.Random(5)
    table, want = table_of(spark, ROWS[:6]), {r[0]: r for r in ROWS[:6]}
    for turn in range(4):
        rows = {i: (i, rng.choice(["p", "q", "r"]), rng.choice(["x", "y", None])) for i in rng.sample(range(12), 5)}
        if turn % 2:
            table.upsert(spark.createDataFrame(list(rows.values()), DDL))
            want |= {i: r for i, r in rows.items()}
        else:
            table.update(spark.createDataFrame(list(rows.values()), DDL))
            want |= {i: (i, r[1], r[2] or want[i][2]) for i, r in rows.items() if i in want}
    same(content(table), list(want.values()))


def test_stored_keys_reads_their_slots(spark):
    table = table_of(spark, [(i, "t", "c") for i in range(50)], slots=8)
    keys = spark.createDataFrame([(3,), (3,), (70,), (None,)], "id long")
    assert [r["id"] for r in table.stored_keys(keys).collect()] == [3]


def test_rewrite_rows_moves_without_loss(spark):
    """The plain layout: rows 1 and 2 in x, 3 and 4 in y, 5 in the null partition."""
    path = scratch_path(spark, "plain")
    spark.createDataFrame(ROWS[:5], DDL).write.partitionBy("cat").parquet(path)
    updates = [(1, None, "y"), (1, "A", "y"), (5, "E", "z"), (9, "no", "x"), (None, "no", "x")]
    for _ in range(2):
        sinks.rewrite_rows(path, spark.createDataFrame(updates, DDL), "cat", schema=DDL)
        found = sorted((tuple(r) for r in spark.read.schema(DDL).parquet(path).collect()), key=str)
        same(found, [(1, "A", "y"), (2, "b", "x"), (3, "c", "y"), (4, "d", "y"), (5, "E", "z")])
    sinks.rewrite_rows(path, spark.createDataFrame([(2, "y")], "id long, cat string"), "cat", schema=DDL)
    assert spark.read.schema(DDL).parquet(path).where("cat = 'x'").count() == 0
    assert spark.read.schema(DDL).parquet(path).count() == 5
