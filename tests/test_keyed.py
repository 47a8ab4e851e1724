import pytest

from folioforge.sources import tables
from folioforge.sources.keyed import Conflict, KeyedTable

SCHEMA = "k long, name string, n int"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", k) for k in range(200)] + [(None, "none", 0), (7, "a", 1)], SCHEMA)
    return KeyedTable.create(rows, str(tmp_path / "t"), ["k"], buckets=16)


def contents(frame):
    return {r.k: (r.name, r.n) for r in frame.collect()}


def test_upserts_replace_add_and_delete(spark, table):
    first = {k: (f"n{k}", k) for k in range(200)} | {None: ("none", 0)}
    assert contents(table.read()) == first and table.read().count() == 201
    fresh = spark.createDataFrame([(3, "x", 1), (500, "new", 5), (None, "still none", 2), (500, "new", 4)], SCHEMA)
    assert table.upsert(fresh, delete=spark.createDataFrame([(9,), (77777,)], "k long")) == 1
    after = first | {3: ("x", 1), 500: ("new", 5), None: ("still none", 2)}
    del after[9]
    assert contents(table.read()) == after and contents(table.read(0)) == first
    assert table.upsert(fresh.limit(0)) == 1
    assert contents(table.read_keys(spark.createDataFrame([(3,), (4,), (9,)], "k long"))) == {3: ("x", 1), 4: ("n4", 4)}


def test_only_touched_buckets_are_read_and_written(spark, table):
    before = set(table.read().inputFiles())
    touched = {r.b for r in spark.createDataFrame([(5,), (6,)], "k long").select(KeyedTable.bucket_of(["k"], 16).alias("b")).collect()}
    read = table._rows(table.state()[1], [str(b) for b in touched]).inputFiles()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} == touched
    table.upsert(spark.createDataFrame([(5, "x", 0), (6, "y", 0)], SCHEMA))
    changed = before ^ set(table.read().inputFiles())
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in changed} == touched
    assert len(table.read_keys(spark.createDataFrame([(5,)], "k long")).inputFiles()) <= 1


def test_writers_of_other_buckets_both_succeed_and_of_the_same_conflict(spark, table):
    one = spark.createDataFrame([(1, "one", 0)], SCHEMA)
    place = {r.k: r.b for r in table.read().select("k", KeyedTable.bucket_of(["k"], 16).alias("b")).collect()}
    other = next(k for k in place if k is not None and place[k] != place[1])
    same = next(k for k in place if k not in (None, 1) and place[k] == place[1])
    assert table.upsert(one) == 1
    assert table.upsert(spark.createDataFrame([(other, "two", 0)], SCHEMA), read_version=0) == 2
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(same, "three", 0)], SCHEMA), read_version=0)
    found = contents(table.read())
    assert found[1][0] == "one" and found[other][0] == "two" and found[same][0] == f"n{same}"
    with pytest.raises(Conflict):
        KeyedTable.create(one, table.path, ["k"])


def test_a_version_taken_meanwhile_is_tried_again(spark, table, monkeypatch):
    commit, lost = table._commit, []

    def late(version, entry):
        if not lost:  # another writer is faster once
            lost.append(version)
            KeyedTable(spark, table.path)._commit(version, table.state()[1])
        return commit(version, entry)

    monkeypatch.setattr(table, "_commit", late)
    assert table.upsert(spark.createDataFrame([(1, "one", 0)], SCHEMA)) == 2 and lost == [1]


def test_what_no_version_needs_goes(spark, table):
    for k in range(3):
        table.upsert(spark.createDataFrame([(1, f"v{k}", k)], SCHEMA))
    before = contents(table.read())
    assert table.vacuum() == 2 and contents(table.read()) == before
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"{table.path}_none").read()


def test_runs_are_published_whole_and_once(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), spark.range(5)
    args = (root, "probe", "r1", "/src", "2024-01-01T00:00:00+00:00")

    def fails(*_, **__):
        raise OSError("lost")

    for step in ("_rename", "write_json", "write_text"):  # where the first, second and third attempt ends
        with monkeypatch.context() as patch:
            patch.setattr(tables, step, fails)
            with pytest.raises(OSError):
                tables.write_run(rows, *args, summary={"a": 1})
        assert not tables.exists(spark, f"{root}/runs") or tables.runs(spark, root).count() == 0
    path = tables.write_run(rows, *args, summary={"a": 1})
    assert tables.write_run(spark.range(50), *args) == path  # published already: nothing is added
    assert [(r.stage, r.run_id, r.path) for r in tables.runs(spark, root).collect()] == [("probe", "r1", path)]
    assert spark.read.parquet(path).count() == 5 and tables.resolve_run(spark, root, "probe") == path
    assert tables.load_run(spark, root, "probe", "r1")[1]["a"] == 1
