"""File trees and archives as tables.

A tree is walked level by level: one job lists the folders of a level in parallel, and the folders found, less those
ignored, are the next one's input. Nothing but the number of folders of a level comes to the driver. Names of any
kind count, those with a leading dot or underscore too, and whatever cannot be read is a row with its error.

Digests are taken in pieces of a megabyte, whole and of the first bytes in one pass; archives are read from their
end, where their directory stands, and a member from the place the directory names. Files of any size therefore need
the same memory.
"""

from __future__ import annotations

import fnmatch
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import paths
from folioforge.operators.probe import output_label

from .storage import chunks, store
from folioforge.staging import staged

HASHES = ("md5", "sha1", "sha256", "none")
#: Recordings that are transcribed.
MEDIA = ("wav", "mp3", "m4a", "mp4")
#: Rows that a task hands over at once.
BATCH = 5_000


def _tables(rows: Iterator[tuple], columns: list[str], **kinds: str) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pd.DataFrame(held, columns=columns).astype(kinds)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns).astype(kinds)


def _message(error: Exception) -> str:
    return f"{type(error).__name__}: {error.strerror if isinstance(error, OSError) and error.strerror else error}"


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly, so that each task gets its share of slow reads."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


# --- trees -------------------------------------------------------------------------------------------------------

_ENTRIES = "rel_path string, kind string, size_bytes long, modified long, created long, error string"


def is_ignored(rel_path: str, patterns: tuple[str, ...]) -> bool:
    """Whether a path, its name, or its last parts match one of the glob patterns."""
    name = rel_path.rpartition("/")[2]
    return any(fnmatch.fnmatchcase(name, p) or fnmatch.fnmatchcase(rel_path, p) or ("/" in p and PurePosixPath(rel_path).match(p)) for p in patterns)


def _listing(root: str, ignore: tuple[str, ...], follow: bool):
    def entries(folder: str) -> Iterator[tuple]:
        try:
            for e in store(root).entries(folder):
                rel = f"{folder}/{e.name}" if folder else e.name
                if is_ignored(rel, ignore):
                    continue
                kind, error = e.kind, e.error
                if kind == "link" and follow:
                    kind, error = ("error", "link to a folder it stands in") if store(root).leads_back(rel) else ("dir", None)
                yield rel, kind, e.size, e.modified, e.created, error
        except OSError as error:
            yield folder, "error", None, None, None, _message(error)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for part in parts for folder in part["folder"] for row in entries(folder))
        yield from _tables(rows, _ENTRIES.replace(" string", "").replace(" long", "").split(", "), size_bytes="Int64", modified="Int64", created="Int64")

    return run


def walk(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = paths.DEFAULT_IGNORES, follow_symlinks: bool = False) -> DataFrame:
    """Everything below root: rel_path, kind (file, dir, link, error), size_bytes, modified and created (microseconds since 1970), error.

    Ignored folders are not entered. A link to a file counts as the file; one to a folder is entered only if asked for,
    and never one that leads to a folder it stands in. A root that cannot be listed is one row with its error.
    """
    levels: list[DataFrame] = []
    folders = spark.createDataFrame([("",)], "folder string")
    while True:
        found = staged(_dealt(folders, "folder").mapInPandas(_listing(root, ignore, follow_symlinks), _ENTRIES), "level")
        levels.append(found)
        folders = found.filter("kind = 'dir'").select(F.col("rel_path").alias("folder"))
        if folders.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _digests(root: str, algorithm: str, sample_bytes: int):
    def digest(rel: str) -> tuple:
        whole, sample, left = hashlib.new(algorithm), hashlib.new(algorithm), sample_bytes
        try:
            with store(root).open(rel) as file:
                for part in chunks(file):
                    whole.update(part)
                    if left > 0:
                        sample.update(part[:left])
                        left -= len(part)
            return rel, whole.hexdigest(), sample.hexdigest() if sample_bytes else "", None
        except OSError as error:
            return rel, None, None, _message(error)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tables((digest(rel) for part in parts for rel in part["rel_path"]), ["rel_path", "hash_value", "sample_hash", "error"])

    return run


def file_digests(files: DataFrame, root: str, algorithm: str = "sha256", sample_bytes: int = 0) -> DataFrame:
    """rel_path, hash_value, sample_hash (of the first sample_bytes; empty without) and error of files below root."""
    if algorithm not in HASHES[:-1]:
        raise ValueError(f"hash is one of {', '.join(HASHES)}")
    return _dealt(files.select("rel_path"), "rel_path").mapInPandas(_digests(root, algorithm, sample_bytes), "rel_path string, hash_value string, sample_hash string, error string")


_FILES = ("rel_path", "size_bytes", "modified", "created", "hash_value", "sample_hash")


def _as_inventory(found: DataFrame, root: str) -> DataFrame:
    ext = paths.extension(F.col("rel_path"))
    mtime, ctime = F.timestamp_micros("modified"), F.timestamp_micros("created")
    return found.select(
        paths.file_id(F.col("rel_path"), F.col("size_bytes"), F.col("modified") / 1e6, F.col("hash_value")).alias("file_id"), "rel_path", F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("abs_path"),
        paths.top_level_folder(F.col("rel_path")).alias("top_level_folder"), ext.alias("extension"), paths.mime_of_path(F.col("rel_path")).alias("detected_mime"), "size_bytes",
        paths.iso_utc(ctime).alias("created_time"), paths.iso_utc(mtime).alias("modified_time"), "hash_value", "sample_hash",
    )


def scan_tree(
    spark: SparkSession, root: str, *, ignore: tuple[str, ...] = paths.DEFAULT_IGNORES, algorithm: str = "none", sample_bytes: int = 0, follow_symlinks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(files as inventory rows, errors by path). A file whose content cannot be hashed is an error and no row."""
    if algorithm not in HASHES:
        raise ValueError(f"hash is one of {', '.join(HASHES)}")
    found = walk(spark, root, ignore=ignore, follow_symlinks=follow_symlinks)
    errors = found.filter("kind = 'error'").select(F.col("rel_path").alias("path"), "error")
    files = found.filter("kind = 'file'")
    if algorithm == "none":
        files = files.withColumns({"hash_value": F.lit(""), "sample_hash": F.lit("")})
    else:
        hashed = staged(file_digests(files, root, algorithm, sample_bytes), "digests")
        errors = errors.unionByName(hashed.filter("error is not null").select(F.col("rel_path").alias("path"), "error"))
        files = files.drop("error").join(hashed.filter("error is null").drop("error"), "rel_path")
    return _as_inventory(files.select(*_FILES), root), errors


def scan_files(spark: SparkSession, root: str, *, max_files: int | None = None, **options) -> DataFrame:
    """One row for each file below root; ``max_files`` keeps the first paths in order and has to be positive."""
    if max_files is not None and max_files <= 0:
        raise ValueError("max_files must be positive")
    out = scan_tree(spark, root, **options)[0]
    return out if max_files is None else out.orderBy("rel_path").limit(max_files)


# --- archives ----------------------------------------------------------------------------------------------------

#: ``place`` is where the member's own header begins, ``packed`` its bytes in the archive, ``method`` how it is packed.
_MEMBERS = "archive string, member string, size_bytes long, mtime double, place long, packed long, method int, crc long, error string"
_MEMBER_COLUMNS = [c.split()[0] for c in _MEMBERS.split(", ")]


def central_directory(root: str, archive: str) -> Iterator[tuple]:
    """An archive's members from its directory, or one row with the error; only the archive's end is read."""
    try:
        with store(root).open(archive) as file, zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if not info.is_dir():
                    try:
                        when = datetime(*info.date_time, tzinfo=timezone.utc).timestamp()
                    except ValueError:  # a date that is none costs the date only
                        when = None
                    method = -1 if info.flag_bits & 1 else info.compress_type  # encrypted
                    yield archive, info.filename.lstrip("/"), info.file_size, when, info.header_offset, info.compress_size, method, info.CRC, None
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError) as e:
        yield (archive, *[None] * 7, f"zip read error: {e}")


def read_member(file, place: int, packed: int, method: int, size: int, crc: int) -> bytes:
    """A member's content from its place in the open archive; ValueError if it is not what the directory says."""
    file.seek(place)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no member at this place")
    file.seek(place + 30 + sum(struct.unpack("<HH", header[26:30])))
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise ValueError("encrypted" if method == -1 else f"packed by method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("content does not agree with its checksum")
    return data


def _members(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for part in parts for archive in part["archive"] for row in central_directory(root, archive))
        yield from _tables(rows, _MEMBER_COLUMNS, size_bytes="Int64", place="Int64", packed="Int64", method="Int32", crc="Int64", mtime="Float64")

    return run


def members_of(archives: DataFrame, root: str) -> DataFrame:
    """archives (archive: a path below root) -> their members, and where each lies."""
    return _dealt(archives.select("archive"), "archive").mapInPandas(_members(root), _MEMBERS)


def archive_members(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Members of the ZIP archives below root, without extraction; a broken archive is one row with its error."""
    zips = walk(spark, root, ignore=ignore).filter("kind = 'file' and lower(rel_path) like '%.zip'")
    return members_of(zips.select(F.col("rel_path").alias("archive")), root)


def member_rows(members: DataFrame, root: str = "", ignore: tuple[str, ...] = paths.DEFAULT_IGNORES) -> DataFrame:
    """Members as inventory rows: archive::member, no hash and no time of creation."""
    rel = F.concat("archive", F.lit(paths.MEMBER), "member")
    ext = paths.extension(F.col("member"))
    good = members.filter("error is null").withColumn("rel_path", rel).filter(~paths.ignored(F.col("rel_path"), ignore))
    mtime = F.coalesce("mtime", F.lit(0.0))
    return good.select(
        paths.file_id(F.col("rel_path"), F.col("size_bytes"), mtime, F.lit("")).alias("file_id"), "rel_path", F.concat(F.lit(root.rstrip("/") + "/" if root else ""), "rel_path").alias("abs_path"),
        paths.top_level_folder(F.col("rel_path")).alias("top_level_folder"), ext.alias("extension"), paths.mime_of_path(F.col("member")).alias("detected_mime"), "size_bytes",
        F.lit(None).cast("string").alias("created_time"), paths.iso_utc(F.timestamp_seconds("mtime")).alias("modified_time"), F.lit("").alias("hash_value"), F.lit("").alias("sample_hash"),
    )


def scan_inventory(spark: SparkSession, root: str, *, max_files: int | None = None, ignore: tuple[str, ...] = paths.DEFAULT_IGNORES, **options) -> tuple[DataFrame, DataFrame]:
    """(files and archive members, errors). ``max_files`` counts both, in order of path."""
    if max_files is not None and max_files <= 0:
        raise ValueError("max_files must be positive")
    files, errors = scan_tree(spark, root, ignore=ignore, **options)
    members = staged(members_of(files.filter("extension = 'zip'").select(F.col("rel_path").alias("archive")), root), "members")
    rows = files.unionByName(member_rows(members, root, ignore))
    errors = errors.unionByName(members.filter("error is not null").select(F.col("archive").alias("path"), "error"))
    return (rows if max_files is None else rows.orderBy("rel_path").limit(max_files)), errors


def _content(root: str):
    def read(rel: str, archive: str | None, place: int | None, packed: int, method: int, size: int, crc: int, error: str | None) -> tuple:
        try:
            if error is not None:
                return rel, None, error
            with store(root).open(rel if archive is None else archive) as file:
                return rel, file.read() if archive is None else read_member(file, int(place), int(packed), int(method), int(size), int(crc)), None
        except (OSError, ValueError, zlib.error) as e:
            return rel, None, _message(e)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part.astype(object).where(part.notna(), None)
            for row in rows.itertuples(index=False):  # one by one: a task holds one file at a time
                yield pd.DataFrame([read(*row)], columns=["path", "content", "error"])

    return run


def read_contents(inventory: DataFrame, root: str) -> DataFrame:
    """path, content and error of inventory rows below root; archive members are read from their place in the archive.

    Each archive's directory is read once, whatever number of its members is asked for. A file that cannot be read is
    a row with its error.
    """
    at = F.instr("rel_path", paths.MEMBER)
    rows = inventory.select("rel_path", F.when(at > 0, F.substring("rel_path", F.lit(1), at - 1)).alias("archive"), F.when(at > 0, F.substring("rel_path", at + 2, F.length("rel_path"))).alias("member"))
    asked = rows.filter("archive is not null")
    # of members of one name the last counts, as in any reader of archives
    held = members_of(asked.select("archive").distinct(), root)
    held = held.groupBy("archive", "member").agg(F.max(F.struct("place", "packed", "method", "size_bytes", "crc", "error")).alias("m")).select("archive", "member", "m.*")
    broken = held.filter("error is not null").select("archive", F.col("error").alias("broken"))
    found = asked.join(held.filter("error is null").drop("error"), ["archive", "member"], "left").join(broken, "archive", "left")
    error = F.when(F.col("place").isNull(), F.coalesce("broken", F.concat(F.lit("KeyError: "), "member")))
    kinds = (("place", "long"), ("packed", "long"), ("method", "int"), ("size_bytes", "long"), ("crc", "long"))
    members = found.select("rel_path", "archive", *(c for c, _ in kinds), error.alias("error"))
    plain = rows.filter("archive is null").select("rel_path", F.lit(None).cast("string").alias("archive"), *(F.lit(None).cast(k).alias(c) for c, k in kinds), F.lit(None).cast("string").alias("error"))
    return _dealt(plain.unionByName(members), "rel_path").mapInPandas(_content(root), "path string, content binary, error string")


def discover_media(inventory: DataFrame, kinds: tuple[str, ...] = MEDIA) -> DataFrame:
    """Recordings of an inventory, archive members among them, in order of path, with a label for their output."""
    found = inventory.filter(F.lower("extension").isin(*kinds))
    at = F.instr("rel_path", paths.MEMBER)
    stem = F.regexp_replace(paths.file_name(F.col("rel_path")), r"\.[^.]+$", "")
    archive = F.regexp_replace(paths.file_name(F.substring("rel_path", F.lit(1), at - 1)), r"\.[^.]+$", "")
    inner = F.regexp_replace(F.substring("rel_path", at + 2, F.length("rel_path")), r"\.[^./]+$", "")
    label = F.when(at > 0, F.concat(archive, F.lit("__"), inner)).otherwise(stem)
    name = paths.file_name(F.when(at > 0, F.substring("rel_path", at + 2, F.length("rel_path"))).otherwise(F.col("rel_path")))
    return found.select("rel_path", name.alias("display_name"), output_label(label).alias("output_label"), "size_bytes").orderBy("rel_path")
