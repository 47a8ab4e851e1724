"""Pages of files through pluggable extractors, of text or of images: extracted once, then reused by every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An extractor gets a file's bytes and yields the text of each page.
Extractor = Callable[[bytes], Iterable[str]]

PAGES = "path string, page_num int, text string, error string"
_PAGES = pa.schema([("path", pa.string()), ("page_num", pa.int32()), ("text", pa.string()), ("error", pa.string())])
#: Characters and pages that a task hands on at once.
HELD, ROWS = 1_000_000, 5_000


def plain_text(content: bytes) -> Iterator[str]:
    """UTF-8 text; form feeds separate pages."""
    yield from content.decode("utf-8", "replace").split("\f")


def pdf_text(content: bytes) -> Iterator[str]:
    """Text of PDF pages with pypdf, where that is installed; a page that cannot be read is empty."""
    import io

    from pypdf import PdfReader

    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            yield page.extract_text() or ""
        except Exception:  # noqa: BLE001  a broken page must not lose the file's others
            yield ""


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("path", "page_num", "text", "error"), r, strict=True)) for r in rows], _PAGES)


def _run(extractor: Extractor, max_pages: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path, content in zip(*batch.columns, strict=True):  # file by file, and pages handed on as they come
                path = path.as_py()
                try:
                    for n, text in enumerate(extractor(bytes(content.as_py())), 1):
                        if max_pages is not None and n > max_pages:
                            break
                        rows.append((path, n, text, None))
                        held += len(text)
                        if held >= HELD or len(rows) >= ROWS:
                            yield _frame(rows)
                            rows, held = [], 0
                except Exception as e:  # noqa: BLE001  an unreadable file is a row with its error
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield _frame(rows)

    return run


def extract_pages(files: DataFrame, extractor: Extractor = plain_text, max_pages: int | None = None) -> DataFrame:
    """files: path and content -> one row a page; a file that cannot be read is one row with its error."""
    return files.select("path", "content").mapInArrow(_run(extractor, max_pages), PAGES)


def errors(pages: DataFrame) -> DataFrame:
    """The side channel of an extraction: what went wrong, by file."""
    return pages.filter("error is not null").select("path", F.col("error").alias("error"))


def error_counts(found: DataFrame) -> DataFrame:
    """Errors by their kind, which is what stands before the first colon."""
    return found.groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n"))


class Raster(NamedTuple):
    """A page as a gray image (rows by columns; None if it could not be rendered), and the objects on it."""

    gray: np.ndarray | None
    fonts: int = 0
    images: int = 0


#: A renderer gets a file's bytes and a resolution and yields its pages.
Renderer = Callable[[bytes, int], Iterable[Raster]]

RASTERS = "path string, page_num int, pixels binary, width int, font_count int, image_count int, error string"


def pgm_pages(content: bytes, dpi: int) -> Iterator[Raster]:
    """Binary PGM images, one after the other; an image is a page with one image on it."""
    at = 0
    while at < len(content):
        fields: list[bytes] = []
        while len(fields) < 4:
            end = at
            while content[at : at + 1] == b"#":  # a comment goes to the end of its line
                at = content.index(b"\n", at) + 1
                end = at
            while content[end : end + 1] not in (b" ", b"\n", b"\t", b"\r", b""):
                end += 1
            if end > at:
                fields.append(content[at:end])
            elif end >= len(content):
                if fields:
                    raise ValueError("an image ends within its header")
                return
            at = end + 1
        if fields[0] != b"P5" or int(fields[3]) > 255:
            raise ValueError("not an 8-bit binary PGM image")
        width, height = int(fields[1]), int(fields[2])
        pixels = np.frombuffer(content, np.uint8, width * height, at)
        yield Raster(pixels.reshape(height, width), images=1)
        at += width * height
        while content[at : at + 1] in (b" ", b"\n", b"\t", b"\r") and at < len(content):
            at += 1


def pdf_rasters(content: bytes, dpi: int) -> Iterator[Raster]:
    """Gray renderings of PDF pages and their fonts and images with PyMuPDF, where that is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            fonts, images = len(page.get_fonts() or ()), len(page.get_images(full=True) or ())
            try:
                pix = page.get_pixmap(dpi=dpi, colorspace=fitz.csGRAY)
                gray = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width) if pix.width and pix.height else None
            except Exception:  # noqa: BLE001  a page that cannot be rendered still has its objects
                gray = None
            yield Raster(gray, fonts, images)


def _render(renderer: Renderer, dpi: int, max_pages: int | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = []
                try:
                    for n, page in enumerate(renderer(bytes(content), dpi), 1):
                        if max_pages is not None and n > max_pages:
                            break
                        done = page.gray is not None
                        rows.append((path, n, page.gray.tobytes() if done else None, page.gray.shape[1] if done else None, page.fonts, page.images, None if done else f"Failed to render page {n}"))
                except Exception as e:  # noqa: BLE001  an unreadable file is a row with its error
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                frame = pd.DataFrame(rows, columns=["path", "page_num", "pixels", "width", "font_count", "image_count", "error"])
                yield frame.astype({c: "Int32" for c in ("page_num", "width", "font_count", "image_count")})

    return run


def extract_rasters(files: DataFrame, renderer: Renderer = pgm_pages, *, dpi: int = 100, max_pages: int | None = None) -> DataFrame:
    """files: path and content -> one row a page: pixels row by row, width, fonts and images on it.

    A page that cannot be rendered has no pixels and an error; a file that cannot be read is one row with its error.
    """
    return files.select("path", "content").mapInPandas(_render(renderer, dpi, max_pages), RASTERS)
