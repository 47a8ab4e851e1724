"""Downloads that are asked for only if they changed: what a server says of addresses, and their files.

Addresses are few beside documents and servers want patience: each task asks for its own, one after the other.
"""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that an answer may take; tries for answers that mean "later"; seconds of the first pause between tries.
TIMEOUT, TRIES, PAUSE = 30, 3, 0.5
_LATER = (429, 500, 502, 503, 504)
_ANSWER = "url string, status_code int, etag string, last_modified string, content_length long, error string"


def _open(url: str, method: str, etag: str | None, modified: str | None):
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    for again in range(TRIES):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            if e.code not in _LATER or again == TRIES - 1:
                return e  # an answer too: 304, 403, 404, ...
        except OSError:
            if again == TRIES - 1:
                raise
        time.sleep(PAUSE * 2**again)
    raise AssertionError


def _text(value) -> str | None:
    return value if isinstance(value, str) and value else None


def _ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for url, etag, modified in zip(part["url"], part["etag"], part["last_modified"], strict=True):
            try:
                answer = _open(url, "HEAD", _text(etag), _text(modified))
                if answer.status in (403, 405):
                    answer.close()
                    answer = _open(url, "GET", _text(etag), _text(modified))
                with answer:
                    size = answer.headers.get("Content-Length")
                    rows.append((url, answer.status, answer.headers.get("ETag"), answer.headers.get("Last-Modified"), int(size) if size and size.isdigit() else None, None))
            except (OSError, ValueError) as e:
                rows.append((url, None, None, None, None, f"{type(e).__name__}: {e}"))
        frame = pd.DataFrame(rows, columns=["url", "status_code", "etag", "last_modified", "content_length", "error"])
        yield frame.astype({"status_code": "Int32", "content_length": "Int64"})


def check(urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """What servers say of each url now, asked with what the manifest knows of it: status 304 means unchanged."""
    known = urls.select("url").distinct().join(manifest.select("url", "etag", "last_modified"), "url", "left")
    return known.mapInPandas(_ask, _ANSWER)


def _download(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, path in zip(part["url"], part["local_path"], strict=True):
                target = os.path.join(root, path)
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    digest, size = hashlib.sha256(), 0
                    with _open(url, "GET", None, None) as answer:
                        if answer.status >= 400:
                            raise OSError(f"status {answer.status}")
                        # a name of its own until it is whole: a task that is run again starts anew
                        part_path = f"{target}.{os.getpid()}.part"
                        with open(part_path, "wb") as file:
                            while chunk := answer.read(1 << 20):
                                file.write(chunk)
                                digest.update(chunk)
                                size += len(chunk)
                        os.replace(part_path, target)
                        rows.append((url, target, answer.headers.get("ETag"), answer.headers.get("Last-Modified"), size, digest.hexdigest(), None))
                except (OSError, ValueError) as e:
                    rows.append((url, target, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["url", "local_path", "etag", "last_modified", "content_length", "sha256", "error"])
            yield frame.astype({"content_length": "Int64"})

    return run


def download(wanted: DataFrame, root: str) -> DataFrame:
    """Fetch url to local_path below ``root``, a folder that all executors share; one row each, with hash or error."""
    schema = "url string, local_path string, etag string, last_modified string, content_length long, sha256 string, error string"
    return wanted.select("url", "local_path").mapInPandas(_download(root.removeprefix("file://")), schema)


def failed(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("error").isNotNull()).select("url", "error")
