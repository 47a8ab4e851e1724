"""Links of a page, what has changed since the last run, and run bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.probe import volume_of

#: Downloads that are followed, and media that are transcribed.
DOWNLOADS = ("zip", "pdf", "mp4", "wav")
MEDIA = ("wav", "mp3", "m4a", "mp4")
_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def _without_dots(path: Column) -> Column:
    """A rooted path without "." and ".." parts; ".." above the root is dropped."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.size(F.split(path, "/", -1)))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none, lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(joined == "/", joined).otherwise(F.concat(joined, ends))


def absolute_url(href: Column, base: Column) -> Column:
    """An address as seen from a page: absolute ones of any scheme stay, others take from the page's address its
    scheme, host, folder, or all of it for a mere query or fragment; "." and ".." parts are resolved.
    """
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"#.*$", "")
    document = F.regexp_replace(page, r"\?.*$", "")
    folder = F.regexp_replace(F.substring(document, F.length(host) + 1, F.lit(1 << 20)), r"[^/]*$", "")
    path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_replace(href, r"^[^?#]*", "")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("?"), F.concat(document, href)).when(href.startswith("#"), F.concat(page, href))
        .otherwise(F.concat(host, _without_dots(rooted), tail))
    )


def _plain(html: Column) -> Column:
    """Text of a fragment: no tags, runs of space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """Every link of each page in order, with its text; anchors without an address are left out."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("position", "anchor"))
    parts = found.select("page_id", "url", "position", F.trim(F.regexp_extract("anchor", _ANCHOR, 1)).alias("href"), _plain(F.regexp_extract("anchor", _ANCHOR, 2)).alias("text"))
    return parts.filter("href <> ''").select("page_id", "position", "text", absolute_url(F.col("href"), F.col("url")).alias("link"))


class _Accordion(HTMLParser):
    """Links under the headings of accordions: a button with its heading, then a content block with anchors."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str, str]] = []
        self.open: list[tuple[str, str]] = []  # (tag, part) of the elements that are open
        self.heading, self.label, self.text, self.href = "", [], [], None

    def _within(self, part: str) -> bool:
        return any(p == part for _, p in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs)
        kinds = set((attributes.get("class") or "").split())
        part = "accordion" if {"usa-accordion", "usa-accordion--bordered"} <= kinds else "button" if tag == "button" and "usa-accordion__button" in kinds else "content" if tag == "div" and "usa-accordion__content" in kinds else ""
        if tag == "a" and attributes.get("href") and self._within("accordion") and self._within("content"):
            self.href, self.text = attributes["href"], []
        if part == "button" and self._within("accordion"):
            self.label = []
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.open.append((tag, part))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        for _, part in self.open[at:]:
            if part == "button":
                self.heading = " ".join("".join(self.label).split())
        del self.open[at:]
        if tag == "a" and self.href is not None:
            if self.href.strip():
                self.found.append((self.heading, " ".join("".join(self.text).split()), self.href.strip()))
            self.href = None

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data.strip())
        elif self._within("button"):
            self.label.append(data.strip())


def _accordions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parser = _Accordion()
            parser.feed(html or "")
            rows += [(page, url, k, *found) for k, found in enumerate(parser.found)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "position", "heading", "text", "href"])


def accordion_links(pages: DataFrame) -> DataFrame:
    """Links in the accordions of a download page, each with its heading and text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", "html").mapInArrow(_accordions, f"page_id {kind}, url string, position int, heading string, text string, href string")
    return found.select("page_id", "position", "heading", "text", absolute_url(F.col("href"), F.col("url")).alias("link"))


def local_path(found: DataFrame) -> DataFrame:
    """Where each link's file is kept: heading, the volume that its text names, and its file name, made safe."""

    def safe(name: Column) -> Column:
        flat = F.translate(F.url_decode(F.regexp_replace(name, r"\+", "%2B")), "/\\", "__")
        return F.trim(F.regexp_replace(F.regexp_replace(flat, r"""[<>:"|?*\x00-\x1f]""", "_"), r"\s+", " "))

    name = F.element_at(F.split(F.regexp_replace(F.regexp_replace("link", r"[?#].*$", ""), "/+$", ""), "/"), -1)
    heading = F.coalesce(F.nullif(safe(F.col("heading")), F.lit("")), F.lit("Other"))
    return found.withColumn("local_path", F.concat_ws("/", heading, volume_of(F.col("text")), safe(name)))


def download_links(found: DataFrame, kinds: tuple[str, ...] = DOWNLOADS) -> DataFrame:
    """The first occurrence of each address with one of the extensions."""
    wanted = found.filter(F.lower(F.regexp_extract(F.regexp_replace("link", r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)).isin(*kinds))
    return wanted.groupBy("link").agg(F.min(F.struct("page_id", "position")).alias("at")).select("link", "at.page_id", "at.position")


def change_status(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do with each address, and by which rule: unchanged if the server says so (304), or if etag, else
    modification date, else length is the manifest's; a rule that does not hold leaves it to the next.
    """
    old = manifest.select("url", F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"), F.col("content_length").alias("old_length"), F.lit(True).alias("known"))
    rows = current.join(old, "url", "left")
    answer = F.col("status_code") if "status_code" in current.columns else F.lit(200)
    rules = [("skipped_304", answer == 304), ("new", F.col("known").isNull())]
    for name, now, then in (("skipped_etag", "etag", "old_etag"), ("skipped_last_modified", "last_modified", "old_modified"), ("skipped_length", "content_length", "old_length")):
        filled = F.coalesce(F.col(now).cast("string"), F.lit("")) != ""
        rules.append((name, filled & F.coalesce(F.col(now) == F.col(then), F.lit(False))))
    status = F.coalesce(*(F.when(condition, name) for name, condition in rules), F.lit("changed"))
    return rows.select("url", status.alias("status"))


def run_status(status: Column, *, dry_run: bool = False, failed: Column | None = None, pages_changed: Column | None = None) -> Column:
    """What a run enters in the manifest: failed, page-count-changed or skipped, dry-run, downloaded."""
    skipped = F.when(F.coalesce(pages_changed, F.lit(False)) if pages_changed is not None else F.lit(False), "page-count-changed").otherwise("skipped")
    out = F.when(status.startswith("skipped"), skipped).otherwise("dry-run" if dry_run else "downloaded")
    return F.when(failed, "failed").otherwise(out) if failed is not None else out


def update_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """The manifest after a run: entries seen replace their old ones, keeping what the run did not learn; others stay."""
    fields = [c for c in manifest.columns if c != "url"]
    new = seen.select("url", *(F.col(c).alias(f"new_{c}") if c in seen.columns else F.lit(None).alias(f"new_{c}") for c in fields), F.lit(True).alias("was_seen"))
    both = manifest.join(new, "url", "full_outer")
    return both.select("url", *(F.coalesce(f"new_{c}", c).alias(c) for c in fields))


def archive_pages(members: DataFrame) -> DataFrame:
    """PDFs and pages of each archive, with the pages of each member."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "pages"))), lambda m: F.concat_ws("=", m["member"], m["pages"].cast("string"))), ",")
    return members.groupBy("archive").agg(F.count("*").alias("pdf_count"), F.sum("pages").alias("total_pages"), each.alias("per_pdf"))


def page_count_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Archives whose members' page counts are others than before."""
    old = before.select("archive", F.col("per_pdf").alias("old_pdf"), F.col("total_pages").alias("old_pages"))
    return now.join(old, "archive").filter("per_pdf <> old_pdf").select("archive", "old_pages", F.col("total_pages").alias("new_pages"))


def run_catalog(runs: DataFrame) -> DataFrame:
    """Runs of each stage, newest first; runs without a time come last."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc_nulls_last("ts"), "run_id")))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage", "source_root").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").alias("ts"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
