"""Views that serve a reviewer: catalog, run comparison, filters, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import paths
from folioforge.functions.formats import number
from folioforge.functions.text import count, literal


def _filled(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def _or_null(df: DataFrame, column: str) -> Column:
    return F.nullif(F.trim(df[column].cast("string")), F.lit("")) if column in df.columns else F.lit(None).cast("string")


#: What a catalog entry takes from the probe; and from the inventory, where an inventory has such a column.
_OF_PROBE = ("doc_type_final", "content_type_pred", "content_type", "classification", "text_quality_label", "title", "summary")
#: Columns that may hold a document's address; the first filled one counts.
URLS = ("document_url", "source_url", "download_url")


def public_index(inv: DataFrame, docs: DataFrame, source_root: str | None = None, urls: tuple[str, ...] = URLS) -> DataFrame:
    """One metadata row a file: what the probe (with the text scan's columns) knows of its path, fallbacks elsewhere.

    Of several probed documents of a path the first counts. Blank values count as missing; a page count or size
    that is no number is 0.
    """
    columns = [*(_or_null(docs, c).alias(c) for c in _OF_PROBE), F.coalesce(*(_or_null(docs, c) for c in urls)).alias("url")]
    pages = (docs["page_count"].try_cast("bigint") if "page_count" in docs.columns else F.lit(None).cast("bigint")).alias("page_count")
    probe = docs.select(paths.normalize_rel_path(F.col("rel_path")).alias("norm_path"), F.struct("doc_id", pages, *columns).alias("p")).groupBy("norm_path").agg(F.min("p").alias("p"))
    names = ("file_id", "rel_path", "extension", "detected_mime", "dataset", "top_level_folder", "title", "summary", "modified_time", "created_time")
    files = inv.select(*(_or_null(inv, c).alias(c) for c in names), F.coalesce(*(_or_null(inv, c) for c in urls)).alias("url"), F.coalesce(inv["size_bytes"].try_cast("bigint"), F.lit(0)).alias("size_bytes"))
    files = files.withColumn("norm_path", paths.normalize_rel_path(F.col("rel_path")))
    rows = files.join(probe, "norm_path", "left")
    ext = F.lower("extension")
    pdf = F.coalesce(ext == "pdf", F.lit(False))
    other = F.when(pdf, "PDF (unprobed)").when(ext.isNull(), "NON_PDF").otherwise(F.concat(F.lit("NON_PDF ("), ext, F.lit(")")))
    name = F.nullif(paths.file_name(F.col("rel_path")), F.lit(""))
    title = F.coalesce("title", "p.title", name, F.lit("Untitled document"))
    return rows.select(
        F.coalesce("file_id", F.nullif("norm_path", F.lit("")), title).alias("id"), title.alias("title"), F.coalesce("summary", "p.summary").alias("summary"),
        F.coalesce("p.doc_type_final", other).alias("doc_type_final"), F.coalesce("p.content_type_pred", "p.content_type", F.when(~pdf, F.col("detected_mime"))).alias("content_type"),
        F.col("p.classification").alias("classification"), F.col("p.text_quality_label").alias("text_quality_label"), F.coalesce("p.page_count", F.lit(0)).alias("page_count"),
        F.coalesce("dataset", "top_level_folder", F.lit(source_root), F.lit("Unknown")).alias("dataset"), F.coalesce("p.url", "url").alias("document_url"),
        "rel_path", ext.alias("extension"), "detected_mime", "size_bytes", "modified_time", "created_time",
    )


def catalog_order(index: DataFrame) -> DataFrame:
    """A catalog in the order in which it is shown: by dataset, then path, missing ones first."""
    return index.orderBy(F.coalesce("dataset", F.lit("")), F.coalesce("rel_path", F.lit("")))


def dataset_summary(index: DataFrame) -> DataFrame:
    """For each dataset its items and the number of volume folders among their paths."""
    volume = F.when(paths.top_level_folder(F.col("rel_path")).rlike(r"^VOL\d{5}$"), paths.top_level_folder(F.col("rel_path")))
    return index.groupBy("dataset").agg(F.count("*").alias("items"), F.countDistinct(volume).alias("volumes"))


def run_date_label(run_id: Column) -> Column:
    """The date that a run's id ends with, as year-month-day; the id itself without one."""
    day = F.regexp_extract(run_id, r"(\d{4})(\d{2})(\d{2})_\d{6}", 0)
    return F.when(day != "", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).otherwise(run_id)


def breakdown(index: DataFrame) -> DataFrame:
    ext = F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("(none)"))
    return index.groupBy("dataset", ext.alias("ext")).agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"))


_COUNTS = ("page_count", "pages_with_text", "total_text_chars")


def prepared(docs: DataFrame) -> DataFrame:
    """Documents of any run made comparable: counts that are none are 0, classes Unknown, texts empty."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("doc_id", "rel_path", "top_level_folder")}
    counts = {c: (number(F.col(c)).cast("long") if c in docs.columns else F.lit(0).cast("long")) for c in _COUNTS}
    kind = F.coalesce("classification", F.lit("Unknown")) if "classification" in docs.columns else F.lit("Unknown")
    return docs.select(*(c.alias(n) for n, c in texts.items()), *(c.alias(n) for n, c in counts.items()), (number(F.col("text_coverage_pct")) if "text_coverage_pct" in docs.columns else F.lit(0.0)).alias("text_coverage_pct"), kind.alias("classification"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of two runs side by side: where they are, class before and after, differences (absent: 0)."""
    cols = ["doc_id", "classification", *_COUNTS]
    left = a.select(*cols, F.lit(True).alias("here")).alias("a")
    right = b.select(*cols, F.lit(True).alias("here")).alias("b")
    both = left.join(right, F.col("a.doc_id") == F.col("b.doc_id"), "full_outer")
    status = F.when(F.col("b.here").isNull(), "only_a").when(F.col("a.here").isNull(), "only_b").otherwise("both")
    deltas = [(F.coalesce(F.col(f"b.{c}"), F.lit(0)) - F.coalesce(F.col(f"a.{c}"), F.lit(0))).alias(f"delta_{c}") for c in _COUNTS]
    kinds = [F.coalesce(f"{s}.classification", F.lit("Unknown")).alias(f"class_{s}") for s in "ab"]
    return both.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), status.alias("status"), *kinds, *deltas)


def count_shift(a: DataFrame, b: DataFrame, key: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Counts by a key in two tables, some keys left out: added, removed or in both, and the difference."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        value = F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.lit("(none)"))
        return df.groupBy(value.alias("k")).agg(F.count("*").alias(name)).filter(~F.col("k").isin(*without) if without else F.lit(True))

    both = counted(a, "n_a").join(counted(b, "n_b"), "k", "full_outer")
    status = F.when(F.col("n_a").isNull(), "Added").when(F.col("n_b").isNull(), "Removed").otherwise("In both")
    n = {s: F.coalesce(f"n_{s}", F.lit(0)) for s in "ab"}
    return both.select(F.col("k").alias("value"), n["a"].alias("n_a"), n["b"].alias("n_b"), (n["b"] - n["a"]).alias("delta"), status.alias("status"))


def top_changes(compared: DataFrame, n: int = 50) -> DataFrame:
    return compared.filter("status = 'both'").orderBy(F.desc(F.abs("delta_total_text_chars")), "doc_id").limit(n).select("doc_id", "delta_page_count", "delta_total_text_chars")


def only_once(compared: DataFrame) -> DataFrame:
    return compared.filter("status <> 'both'").select("doc_id", "status")


def run_delta(first: DataFrame, last: DataFrame) -> DataFrame:
    """Files and bytes by folder in a first and a last inventory, with the total."""

    def by(df: DataFrame, s: str) -> DataFrame:
        return df.groupingSets([[F.col("top_level_folder")], []], "top_level_folder").agg(F.count("*").alias(f"files_{s}"), F.sum("size_bytes").alias(f"bytes_{s}")).withColumn("folder", F.coalesce("top_level_folder", F.lit("(total)"))).drop("top_level_folder")

    both = by(first, "first").join(by(last, "last"), "folder", "full_outer").na.fill(0)
    return both.select("folder", "files_first", "files_last", (F.col("files_last") - F.col("files_first")).alias("files_delta"), (F.col("bytes_last") - F.col("bytes_first")).alias("bytes_delta"))


def filter_documents(rows: DataFrame, *, pages: tuple[int, int] | None = None, coverage: tuple[float, float] | None = None, size_mb: tuple[float, float] | None = None, classes: tuple = (), extensions: tuple = (), media_types: tuple = ()) -> DataFrame:
    """Facets combined; an empty selection does not restrict."""
    for column, span in (("page_count", pages), ("text_coverage_pct", coverage), ("size_mb", size_mb)):
        if span:
            rows = rows.filter(F.col(column).between(*span))
    for column, chosen in (("classification", classes), ("extension", extensions), ("detected_mime", media_types)):
        if chosen:
            rows = rows.filter(F.col(column).isin(*chosen))
    return rows


def with_files(docs: DataFrame, inv: DataFrame) -> DataFrame:
    """Documents with their file's extension, type and size in MiB."""
    size = F.round(F.col("size_bytes") / 1024.0**2, 2).alias("size_mb")
    return docs.join(inv.select("rel_path", "extension", "detected_mime", "top_level_folder", size), "rel_path", "left")


def filter_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("docs"), F.sum("page_count").alias("pages"), F.round(F.avg("text_coverage_pct"), 6).alias("avg_coverage"), F.min("page_count").alias("min_pages"), F.max("page_count").alias("max_pages"))


def path_search(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.filter(F.col("rel_path").rlike("(?i)" + pattern))


def labeling_queue(docs: DataFrame, quality: DataFrame, labels: DataFrame, most_pages: int = 5, *, focus: tuple[str, ...] = ("EMPTY", "LOW"), folder: str | None = None) -> DataFrame:
    """Short documents without a label whose text has one of the labels ``focus`` (none counts as EMPTY), of one folder
    if asked for; shortest first.
    """
    rows = docs.join(quality.select("doc_id", "text_quality_label"), "doc_id", "left").join(labels.select("doc_id"), "doc_id", "left_anti")
    rows = rows.filter(F.col("page_count").between(1, most_pages) & F.coalesce("text_quality_label", F.lit("EMPTY")).isin(*focus))
    if folder is not None:
        rows = rows.filter(paths.top_level_folder(F.col("rel_path")) == folder)
    return rows.select("doc_id", "rel_path", "page_count", "text_quality_label").orderBy("page_count", "rel_path")


def candidates(docs: DataFrame, best: bool, n: int = 20) -> DataFrame:
    order = F.desc if best else F.asc
    return docs.orderBy(order("text_coverage_pct"), order("page_count"), "doc_id").limit(n).select("doc_id", "text_coverage_pct", "page_count")


def keyword_search(page_text: DataFrame, keyword: str, case_sensitive: bool = False) -> DataFrame:
    """Documents with a keyword: matches, and pages with their counts."""
    hits = page_text.select("doc_id", "page_num", count(F.col("text"), ("" if case_sensitive else "(?Ui)") + literal(keyword)).alias("n")).filter("n > 0")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "n"))), lambda p: F.concat_ws(":", p["page_num"].cast("string"), p["n"].cast("string"))), ",")
    return hits.groupBy("doc_id").agg(F.sum("n").alias("matches"), F.count("*").alias("pages"), shown.alias("page_hits"))


def highlight(page_text: DataFrame, keyword: str, case_sensitive: bool = False) -> DataFrame:
    """Pages with a keyword, as HTML: markup of the text escaped, each occurrence marked."""
    rx = ("" if case_sensitive else "(?Ui)") + literal(keyword)
    safe = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(char), F.lit(name))
    return page_text.filter(F.col("text").rlike(rx)).select("doc_id", "page_num", F.regexp_replace(safe, rx, "<mark>$0</mark>").alias("marked"))


def needing_attention(docs: DataFrame) -> DataFrame:
    """Documents that are not simply text."""
    return docs.filter(F.coalesce("classification", F.lit("")) != "Text-based")


def pages_lacking_text(page_table: DataFrame, least: int) -> DataFrame:
    """Pages with fewer characters than a threshold chosen for the moment."""
    return page_table.filter(F.coalesce("text_char_count", F.lit(0)) < least).select("doc_id", "rel_path", "page_num", "text_char_count")


#: What a list of documents can be sorted by.
SORTS = {"path": "rel_path", "pages": "page_count", "size": "size_mb"}


def sort_documents(rows: DataFrame, by: str = "path", ascending: bool = True) -> DataFrame:
    """Documents by path, pages or size, equal ones by path."""
    if by not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    return rows.orderBy((F.asc if ascending else F.desc)(SORTS[by]), "rel_path")


def facets(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The distinct filled values of each column with their counts, in one pass."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(values.alias("v")).select("v.*").filter("coalesce(value, '') <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def text_ready(quality: DataFrame) -> DataFrame:
    """Shares of good documents and of those that need work."""
    good, poor = F.count_if(F.col("text_quality_label") == "GOOD"), F.count_if(F.col("text_quality_label").isin("EMPTY", "LOW"))
    return quality.agg(F.count("*").alias("docs"), F.round(good / F.count("*"), 6).alias("good_share"), F.round(poor / F.count("*"), 6).alias("poor_share"))


def text_page_index(page_table: DataFrame) -> DataFrame:
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("page_num")), lambda p: p.cast("string")), ",")
    return page_table.filter("has_text and page_num > 0").groupBy("rel_path").agg(pages.alias("pages"))


def document_text(page_text: DataFrame) -> DataFrame:
    """Pages under their headings, as one text."""
    shown = F.concat(F.lit("--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.coalesce(F.nullif("text", F.lit("")), F.lit("(no text extracted)")))
    pages = F.array_sort(F.collect_list(F.struct("page_num", shown.alias("shown"))))
    return page_text.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["shown"]), "\n\n").alias("document_text"))


def numeric_histogram(rows: DataFrame, column: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """Counts in equal bins; the upper end belongs to the last."""
    at = F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return rows.filter(F.col(column).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("docs"))


def display_label(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat_ws(" · ", "rel_path", "classification", F.concat(F.col("page_count").cast("string"), F.lit(" pages"))).alias("display_label"))


def sample(rows: DataFrame, key: str, n: int, seed: int, within: str | None = None) -> DataFrame:
    """n rows (of each group) with the smallest hash of key and seed: the same ones every time."""
    from pyspark.sql import Window

    named = [F.col(c).cast("string") for c in ((within, key) if within else (key,))]
    order = F.sha2(F.concat_ws("|", *named, F.lit(str(seed))).cast("binary"), 256)
    if within is None:
        return rows.orderBy(order, key).limit(n)
    place = F.row_number().over(Window.partitionBy(within).orderBy(order, key))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")
