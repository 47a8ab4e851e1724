"""Column functions on relative paths, sizes and times."""

from __future__ import annotations

import fnmatch
import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

MEMBER = "::"
#: Names that an inventory leaves out by default.
DEFAULT_IGNORES = ("*.DS_Store", "Thumbs.db", "~$*")


def normalize_rel_path(path: Column) -> Column:
    """Forward slashes, no empty or "." parts; an archive member keeps its first "::". Null is empty."""
    text = F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), r"^\s+|\s+$", "")

    def clean(part: Column) -> Column:
        return F.array_join(F.filter(F.split(part, "/"), lambda p: ~p.isin("", ".")), "/")

    at = F.instr(text, MEMBER)
    return F.when(at == 0, clean(text)).otherwise(F.concat(clean(F.substring(text, F.lit(1), at - 1)), F.lit(MEMBER), clean(F.substring(text, at + 2, F.length(text)))))


def top_level_folder(path: Column) -> Column:
    """The first part that names a volume (VOL and five digits, upper-cased), else the first part, else empty."""
    parts = F.filter(F.split(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/|::"), lambda p: ~p.isin("", "."))
    volume = F.upper(F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^(?i)VOL\d{5}$")), F.lit(1)))
    return F.coalesce(volume, F.try_element_at(parts, F.lit(1)), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case without its dot; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def parent(path: Column) -> Column:
    """The folder of a path; "." for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def depth(folder: Column) -> Column:
    return F.when(folder == ".", 0).otherwise(F.size(F.split(folder, "/")))


def file_id(rel_path: Column, size: Column, mtime: Column, content_hash: Column) -> Column:
    """sha256 of the content hash, or without one of path, size and modification time."""
    basis = F.concat_ws("|", F.coalesce(rel_path, F.lit("")), F.coalesce(size.cast("string"), F.lit("")), F.format_string("%.6f", mtime))
    return F.sha2(F.when(F.coalesce(content_hash, F.lit("")) != "", content_hash).otherwise(basis).cast("binary"), 256)


def stable_doc_id(content_hash: Column, rel_path: Column, size: Column, modified: Column) -> Column:
    """The content hash, or without one path, size and time joined by bars."""
    return F.coalesce(F.nullif(F.trim(content_hash), F.lit("")), F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (rel_path, size, modified))))


def ignored(rel_path: Column, patterns: tuple[str, ...] = DEFAULT_IGNORES) -> Column:
    """Whether the name, the whole path, or its last parts match one of the glob patterns."""
    out = F.lit(False)
    for p in patterns:
        pattern = fnmatch.translate(p).replace(r"\Z", r"\z")
        out = out | rel_path.rlike(pattern) | file_name(rel_path).rlike(pattern)
        if "/" in p:  # as many last parts as the pattern has
            parts = p.strip("/").split("/")
            tail = F.array_join(F.slice(F.split(rel_path, "/"), -len(parts), len(parts)), "/")
            each = "/".join(fnmatch.translate(x).replace(r"\Z", "").replace("(?s:", "(?:").replace(".*", "[^/]*") for x in parts)
            out = out | (F.size(F.split(rel_path, "/")) >= len(parts)) & tail.rlike(f"^{each}$")
    return out


def safe_member_path(entry: Column) -> Column:
    """An archive entry without leading slashes and parts that leave the archive."""
    return F.array_join(F.filter(F.split(F.translate(entry, "\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def extract_folder(archive: Column) -> Column:
    """Where members of an archive are put: its stem and eight digits of its path's hash."""
    return F.concat(F.regexp_replace(file_name(archive), r"\.[^.]+$", ""), F.lit("_"), F.substring(F.sha2(archive.cast("binary"), 256), 1, 8))


_KNOWN = mimetypes.MimeTypes()
#: Registered types that Python's table lacks in some versions.
_REGISTERED = (
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("odt", "application/vnd.oasis.opendocument.text"),
    ("ods", "application/vnd.oasis.opendocument.spreadsheet"),
    ("rtf", "application/rtf"),
    ("heic", "image/heic"),
    ("md", "text/markdown"),
    ("m4a", "audio/mp4"),
)
#: Compressions that hide a name's type behind theirs, and short forms of such names.
_PACKED = "|".join(sorted(e[1:] for e in _KNOWN.encodings_map))
_SHORT = tuple((e[1:], long[1:]) for e, long in sorted(_KNOWN.suffix_map.items()))


def mime_of(ext: Column) -> Column:
    """Type by extension, from Python's own table and the registered ones; anything unknown is application/octet-stream."""
    known = dict(_REGISTERED) | {e[1:]: kind for e, kind in _KNOWN.types_map[True].items()}
    table = F.create_map(*(F.lit(x) for e, kind in sorted(known.items()) for x in (e, kind)))
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def mime_of_path(path: Column) -> Column:
    """Type by a path's name: that of what is inside a compressed file, if the name says so."""
    name = path
    for short, long in _SHORT:
        name = F.regexp_replace(name, rf"\.{short}$", f".{long}")
    return mime_of(extension(F.regexp_replace(name, rf"(?<=[^/])\.({_PACKED})$", "")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_utc(text: Column) -> Column:
    """A time in any of the written forms; null if it is none."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd_HHmmss")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


#: Extensions of file categories.
CATEGORY_EXTENSIONS = (
    ("pdf", ("pdf",)),
    ("text", ("txt", "log", "md")),
    ("csv", ("csv", "tsv")),
    ("image", ("jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp", "heic")),
)


def file_category(ext: Column, mime: Column) -> Column:
    """pdf before text before csv before image before other, by extension or media type."""
    e, m = F.ltrim(F.lower(F.coalesce(ext, F.lit(""))), F.lit(".")), F.lower(F.coalesce(mime, F.lit("")))
    tabular = m.contains("csv") | m.contains("tsv")
    by_mime = {"pdf": m.startswith("application/pdf"), "text": m.startswith("text/") & ~tabular, "csv": tabular, "image": m.startswith("image/")}
    out = F.lit("other")
    for name, extensions in reversed(CATEGORY_EXTENSIONS):
        out = F.when(e.isin(*extensions) | by_mime[name], name).otherwise(out)
    return out
