"""Keyed tables in hash buckets: an upsert reads and writes only the buckets of the keys it brings.

A table is a folder. ``data/<write>/bucket=<n>`` holds the rows of one bucket as one write left them; ``log/<version>``
says for each bucket which write is the valid one. A write puts its buckets into a folder of its own and then takes
the next version by creating that file, which only one writer can: readers see all of a write or nothing, and go on
reading the version they began with. A writer that finds the version taken looks at what was written meanwhile:
other buckets are taken over, the same ones are a conflict.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.staging import staged


class Conflict(RuntimeError):
    """Another writer has written a bucket since it was read."""


class KeyedTable:
    """A table with one row for each key; ``buckets`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log: small files with at most one entry for each bucket

    def _versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{version:020}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, version: int, entry: dict) -> bool:
        """Whether this writer got the version: a whole file is renamed to a name that must be free."""
        hidden, target = self._hadoop.Path(f"{self.path}/log/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{self.path}/log/{version:020}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        context = self._hadoop.FileContext.getFileContext(hidden.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(target), options)
        except Exception as e:
            self._fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def state(self) -> tuple[int, dict]:
        """(version, its entry) as of now."""
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        return versions[-1], self._entry(versions[-1])

    # rows

    @staticmethod
    def bucket_of(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int, keys: list[str]) -> dict[str, str]:
        """Rows in a folder of this write; returns where each bucket is."""
        write = uuid.uuid4().hex
        marked = rows.withColumn("bucket", self.bucket_of(keys, buckets))
        marked.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        found = self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/{write}"))
        names = [s.getPath().getName() for s in found if s.isDirectory()]
        return {n.partition("=")[2]: write for n in names if n.startswith("bucket=")}

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """A new table; of rows with one key the last in order of all columns stays."""
        if "bucket" in rows.columns:
            raise ValueError("bucket is the name of the table's own column")
        table = cls(rows.sparkSession, path)
        where = table._write(one_row_a_key(rows, keys), buckets, keys)
        if not table._commit(0, {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "where": where}):
            raise Conflict(f"there is a table at {path}")
        return table

    def _rows(self, entry: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        at = [f"{self.path}/data/{entry['where'][b]}/bucket={b}" for b in buckets if b in entry["where"]]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.state()[1] if version is None else self._entry(version)
        return self._rows(entry, sorted(entry["where"], key=int))

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        entry = self.state()[1]
        touched = self._touched(keys, entry)
        return self._rows(entry, touched).join(keys.select(*entry["keys"]).distinct(), entry["keys"], "left_semi")

    def _touched(self, rows: DataFrame, entry: dict) -> list[str]:
        numbers = rows.select(self.bucket_of(entry["keys"], entry["buckets"]).alias("b")).distinct().collect()  # at most one for each bucket
        return sorted((str(r["b"]) for r in numbers), key=int)

    def upsert(self, rows: DataFrame, *, delete: DataFrame | None = None, read_version: int | None = None, attempts: int = 10) -> int:
        """Rows take the place of those with their keys; keys of ``delete`` go. Returns the new version.

        ``read_version`` is the version that the rows were made from, by default the newest: Conflict if one of
        the buckets they touch has been written since. Null keys are keys like others.
        """
        version, entry = self.state()
        if read_version is not None:
            version, entry = read_version, self._entry(read_version)
        keys, schema = entry["keys"], T.StructType.fromJson(entry["schema"])
        new = staged(one_row_a_key(rows.select(*schema.names), keys), "rows")
        gone = new.select(*keys) if delete is None else new.select(*keys).unionByName(delete.select(*keys)).distinct()
        touched = self._touched(gone, entry)
        if not touched:
            return version
        old = self._rows(entry, touched)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
        kept = old.alias("o").join(gone.alias("g"), same, "left_anti").select("o.*")
        where = self._write(kept.unionByName(new), entry["buckets"], keys)
        for _ in range(attempts):
            current, latest = self.state()
            if any(latest["where"].get(b) != entry["where"].get(b) for b in touched):
                raise Conflict(f"buckets of {self.path} have been written since version {version}")
            after = {b: w for b, w in latest["where"].items() if b not in touched} | where
            if self._commit(current + 1, latest | {"where": after}):
                return current + 1
        raise Conflict(f"no version of {self.path} was free in {attempts} attempts")

    def vacuum(self, keep: int = 1) -> int:
        """Delete writes that none of the newest ``keep`` versions needs, and older versions; returns how many writes."""
        versions = self._versions()
        needed = {w for v in versions[-keep:] for w in self._entry(v)["where"].values()}
        folder, count = self._hadoop.Path(f"{self.path}/data"), 0
        for s in self._fs.listStatus(folder):
            if s.getPath().getName() not in needed:
                count += bool(self._fs.delete(s.getPath(), True))
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/log/{v:020}"), False)
        return count


def one_row_a_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key the one that is last in order of all other columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, "row.*").select(*rows.columns)
