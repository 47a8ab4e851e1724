"""Folders and files as tasks see them: listed, opened and read by ranges, on any store that tasks can reach.

A local or mounted path is read through the operating system; other addresses (s3, gs, hdfs, abfs) through Arrow's file
systems, which need no JVM in the task. Both give seekable streams, so that a file's end can be read without its
beginning.
"""

from __future__ import annotations

import functools
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

#: Bytes asked for at once.
CHUNK = 1 << 20


@dataclass(slots=True)
class Entry:
    """What a folder holds: a file, a folder or a link to a folder, or what could not be looked at."""

    name: str
    kind: str  #: file, dir, link or error
    size: int | None = None
    modified: int | None = None  #: microseconds since 1970
    created: int | None = None
    error: str | None = None


class LocalStore:
    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def entries(self, rel: str) -> Iterator[Entry]:
        with os.scandir(self.path(rel)) as found:
            for e in found:
                try:
                    seen = e.stat()
                    folder = stat.S_ISDIR(seen.st_mode)
                    kind = ("link" if e.is_symlink() else "dir") if folder else "file"
                    yield Entry(e.name, kind, None if folder else seen.st_size, seen.st_mtime_ns // 1000, seen.st_ctime_ns // 1000)
                except OSError as error:
                    yield Entry(e.name, "error", error=f"{type(error).__name__}: {error.strerror}")

    def leads_back(self, rel: str) -> bool:
        """Whether a link leads to a folder it stands in, so that following it would never end."""
        real = os.path.realpath(self.path(rel))
        return (os.path.realpath(os.path.dirname(self.path(rel))) + "/").startswith(real.rstrip("/") + "/")

    def open(self, rel: str) -> BinaryIO:
        return open(self.path(rel), "rb")

    def write(self, rel: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(self.path(rel)), exist_ok=True)
        with open(self.path(rel), "wb") as file:
            file.write(content)

    def link(self, rel: str, target: str) -> None:
        os.makedirs(os.path.dirname(self.path(rel)), exist_ok=True)
        if not os.path.lexists(self.path(rel)):  # a task may be run again
            os.symlink(target, self.path(rel))


class ArrowStore:
    def __init__(self, address: str):
        from pyarrow.fs import FileSystem

        self.system, self.root = FileSystem.from_uri(address.rstrip("/"))

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def entries(self, rel: str) -> Iterator[Entry]:
        from pyarrow.fs import FileSelector, FileType

        for e in self.system.get_file_info(FileSelector(self.path(rel))):
            folder = e.type == FileType.Directory
            modified = None if e.mtime_ns is None else e.mtime_ns // 1000
            yield Entry(e.base_name, "dir" if folder else "file", None if folder else e.size, modified)

    def leads_back(self, rel: str) -> bool:
        return False

    def open(self, rel: str) -> BinaryIO:
        return self.system.open_input_file(self.path(rel))

    def write(self, rel: str, content: bytes) -> None:
        self.system.create_dir(self.path(rel).rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(self.path(rel)) as file:
            file.write(content)

    def link(self, rel: str, target: str) -> None:
        raise NotImplementedError("this store has no links")


@functools.lru_cache(maxsize=16)
def store(root: str) -> LocalStore | ArrowStore:
    """The store that holds a root, as this process reaches it."""
    if root.startswith("file:"):
        return LocalStore("/" + root[5:].lstrip("/"))
    return ArrowStore(root) if "://" in root else LocalStore(root)


def chunks(file: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    while part := file.read(size):
        yield part
