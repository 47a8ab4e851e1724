import datetime

import pytest

from folioforge.streaming import changes, ingest

SEEN = "url string, etag string, last_modified string, content_length long, status_code int, seen_at timestamp"
HOUR = 3_600_000


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


class Addresses:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.schema = spark.createDataFrame([], SEEN).schema

    def arrive(self, *rows):
        self.spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self

    def follow(self, **options):
        stream = ingest.new_files(self.spark, f"{self.folder}/in", self.schema)
        changes.follow_changes(stream, f"{self.folder}/out", f"{self.folder}/progress", **options)
        return sorted((r.url, r.seen_at.hour + 24 * (r.seen_at.day - 1), r.status) for r in self.spark.read.schema(changes.STATUSES).parquet(f"{self.folder}/out").collect())


def test_changes_against_state(spark, tmp_path):
    a = Addresses(spark, tmp_path)
    a.arrive(("a", "1", None, 1, 200, at(0)), ("b", "1", "Mon", 1, 200, at(0)), ("b", "2", "Tue", 2, 200, at(1)), (None, "x", None, 1, 200, at(0)), ("d", None, None, None, 304, at(0)))
    assert a.follow() == [("a", 0, "new"), ("b", 0, "new"), ("b", 1, "changed"), ("d", 0, "skipped_304")]
    a.arrive(("a", None, None, 1, 200, at(2)), ("b", "3", "Tue", 9, 200, at(2)), ("c", "", None, None, 200, at(2)), ("d", "1", None, 5, 200, at(2)))
    assert a.follow()[-1:] == [("d", 2, "changed")] and {s for u, h, s in a.follow() if h == 2 and u != "d"} == {"skipped_length", "skipped_last_modified", "new"}
    known = {r.url: (r.etag, r.last_modified, r.content_length, r.seen_at) for r in changes.known_addresses(spark, f"{tmp_path}/progress").collect()}
    assert known == {"a": ("1", None, 1, at(2)), "b": ("3", "Tue", 9, at(2)), "c": (None, None, None, at(2)), "d": ("1", None, 5, at(2))} or known["c"][0] in (None, "")
    assert known["a"] == ("1", None, 1, at(2)) and known["b"] == ("3", "Tue", 9, at(2))


def test_addresses_not_seen_again_are_gone(spark, tmp_path):
    a = Addresses(spark, tmp_path)
    a.arrive(("a", "1", None, 1, 200, at(0)), ("b", "1", None, 1, 200, at(0))).follow(gone_after_ms=3 * HOUR)
    a.arrive(("a", "1", None, 1, 200, at(2))).follow(gone_after_ms=3 * HOUR)
    found = a.arrive(("a", "1", None, 1, 200, at(6))).follow(gone_after_ms=3 * HOUR)
    assert [r for r in found if r[2] == "gone"] == [("a", 2, "gone"), ("b", 0, "gone")] or [r for r in found if r[2] == "gone"] == [("b", 0, "gone")]
    assert {r.url for r in changes.known_addresses(spark, f"{tmp_path}/progress").collect()} == {"a"}


def test_a_watch_reads_each_file_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), spark.range(1).schema
    (tmp_path / "in").mkdir()
    watch = ingest.Watch(source, str(tmp_path / "table"), str(tmp_path / "progress"), schema, every="0 seconds", max_files=2)
    with pytest.raises(RuntimeError):
        watch.caught_up()
    watch.start(spark)
    with pytest.raises(RuntimeError):
        watch.start(spark)
    spark.range(0, 50, 1, 5).write.mode("append").parquet(source)
    watch.caught_up()
    assert spark.read.parquet(watch.table).count() == 50
    spark.range(50, 90, 1, 4).write.mode("append").parquet(source)
    watch.stop()  # perhaps in the midst of a batch
    spark.range(90, 100, 1, 2).write.mode("append").parquet(source)
    watch.start(spark).caught_up()
    watch.stop()
    assert sorted(r.id for r in spark.read.parquet(watch.table).collect()) == list(range(100))
    assert watch.failure is None


def test_late_rows_have_their_own_table(spark, tmp_path):
    base, schema = str(tmp_path), spark.createDataFrame([], "ts timestamp, k int").schema
    for lot in ([(at(0), 1), (at(10), 2)], [(at(7), 3), (at(5), 4), (at(9), 5)], [], [(at(20), 6), (None, 7)], [(at(17), 8), (at(19), 9)]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        ingest.split_late(ingest.new_files(spark, f"{base}/in", schema), base, f"{base}/progress", late_ms=2 * HOUR)
    assert {r.k for r in spark.read.parquet(f"{base}/late").collect()} == {3, 4, 8}
    assert sorted(r.k for r in spark.read.parquet(f"{base}/on_time").collect()) == [1, 2, 5, 6, 7, 9]


def test_sessions_end_with_the_watermark(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([(at(0), 1, 1.0), (at(1), 1, 2.0), (at(5), 1, 4.0), (at(1), 2, 1.0)], "ts timestamp, user_id long, value double")
    rows.write.parquet(f"{base}/in")

    def run():
        ingest.run_available(ingest.session_counts(ingest.new_files(spark, f"{base}/in", rows.schema), gap="2 hours", late="1 hour"), f"{base}/out", f"{base}/progress")
        return sorted((r.user_id, r.first, r["last"], r.n, r.total) for r in spark.read.parquet(f"{base}/out").collect())

    assert run() == [(1, at(0), at(1), 2, 3.0), (2, at(1), at(1), 1, 1.0)]
    spark.createDataFrame([(at(30), 3, 1.0)], rows.schema).write.mode("append").parquet(f"{base}/in")
    assert run() == [(1, at(0), at(1), 2, 3.0), (1, at(5), at(5), 1, 4.0), (2, at(1), at(1), 1, 1.0)]
    batch = {(r.user_id, r.first, r["last"], r.n) for r in ingest.session_counts(rows, gap="2 hours").collect()}
    assert batch == {(1, at(0), at(1), 2), (1, at(5), at(5), 1), (2, at(1), at(1), 1)}


def test_an_address_asks_for_its_state_once():
    import pandas as pd

    class Known:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.value = value

    judge = changes.Changes(None)
    judge.known = Known()
    row = pd.DataFrame({"etag": ["1"], "last_modified": [None], "content_length": [3], "status_code": [200], "seen_at": [pd.Timestamp(at(0))]})
    found = [next(judge.handleInputRows(("a",), iter([row]), None)).status.tolist() for _ in range(2)]
    assert found == [["new"], ["skipped_etag"]] and judge.known.calls == 2
