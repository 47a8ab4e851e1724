"""ZIP archives as a data source of Spark: ``spark.read.format("archives").load(root)``.

A row is a member: archive (path below the root), member, size_bytes, mtime, content, error. Planning reads the
archives' directories, each from the archive's end, and deals the members to partitions by their packed bytes,
so that one large archive is read by many tasks and many small ones by one; a task seeks to each of its members and
reads no more than that. Filters on archive and member (=, in, starts with, and the like of "a%") are applied
while planning: archives that they rule out are not opened, members that they rule out not read.

Planning is one process. Trees with more archives than that can open are read by ``files.archive_members`` and
``files.read_contents``, whose directories are read by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from .files import central_directory, read_member
from .storage import store

#: Packed bytes of a partition, and what a member counts for besides.
PARTITION_BYTES, MEMBER_BYTES = 64 << 20, 4 << 10
SCHEMA = "archive string, member string, size_bytes long, mtime double, content binary, error string"


class Members(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("content", "true").lower() != "false", int(self.options.get("partitionbytes", PARTITION_BYTES)))


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str, content: bool, partition_bytes: int):
        self.root, self.content, self.partition_bytes = root, content, partition_bytes
        self.tests: list[tuple[str, str, object]] = []  # (column, how, value)

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the data source's own name
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("archive", "member") and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((column, type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, column: str, value: str | None) -> bool:
        for of, how, other in self.tests:
            if of == column:
                if value is None or (how == "EqualTo" and value != other) or (how == "In" and value not in other) or (how == "StringStartsWith" and not value.startswith(other)):
                    return False
        return True

    def _archives(self) -> Iterator[str]:
        folders = [""]
        while folders:
            folder = folders.pop()
            for e in store(self.root).entries(folder):
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.kind == "dir":
                    folders.append(rel)
                elif e.kind == "file" and rel.lower().endswith(".zip") and self._wanted("archive", rel):
                    yield rel

    def partitions(self) -> list[InputPartition]:
        def members(archive: str) -> list[tuple]:
            return [row for row in central_directory(self.root, archive) if self._wanted("member", row[1])]

        parts: list[InputPartition] = []
        rows: list[tuple] = []
        held = 0
        with ThreadPoolExecutor(16) as pool:  # waiting for the store, not computing
            for found in pool.map(members, sorted(self._archives())):
                for row in sorted(found, key=lambda r: r[4] or 0):
                    cost = (row[5] or 0) + MEMBER_BYTES
                    if rows and held + cost > self.partition_bytes:
                        parts.append(Members(rows))
                        rows, held = [], 0
                    rows.append(row)
                    held += cost
        return [*parts, Members(rows)]

    def read(self, partition: Members) -> Iterator[tuple]:
        name = file = None
        try:
            for archive, member, size, mtime, place, packed, method, crc, error in partition.rows:
                content = None
                if error is None and self.content:
                    try:
                        if archive != name:
                            if file is not None:
                                file.close()
                            name, file = archive, store(self.root).open(archive)
                        content = read_member(file, place, packed, method, size, crc)
                    except Exception as e:  # noqa: BLE001  an unreadable member is a row with its error
                        error = f"{type(e).__name__}: {e}"
                yield archive, member, size, mtime, content, error
        finally:
            if file is not None:
                file.close()


def read_archives(spark: SparkSession, root: str, *, content: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Members of all ZIP archives below root, with their content if asked for; a broken archive is one row with its error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    return spark.read.format("archives").option("content", str(content).lower()).option("partitionbytes", partition_bytes).load(root)
