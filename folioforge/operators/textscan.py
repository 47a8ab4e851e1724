"""Text quality and content type: page statistics rolled up to documents.

Everything of a page is computed in one projection, then summed; nothing is joined and one shuffle by document
is enough, for readiness, quality and type together if all are wanted. Pages are never joined into one text, since
runs, lines and rules end with a page.

A scan reads the pages on which the probe found text; of a document without such a page it reads all. Sums are taken
over both, and a document's are those over its text pages if it has any: that needs no second pass over pages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.functions.rules import CATEGORIES, GUARDS, RULES
from folioforge.operators import readiness
from folioforge.staging import staged


@dataclass(frozen=True)
class Quality:
    """Bounds of the text quality labels."""

    empty_chars: int = 50
    empty_words: int = 10
    alpha: float = 0.45
    printable: float = 0.95
    gibberish: float = 0.60
    gibberish_words: int = 30
    symbols: float = 0.45
    run: int = 4
    run_share: float = 0.12
    snippet: int = 200


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _has_text(ready: readiness.Thresholds) -> Column:
    return F.length(t.strip(F.coalesce("text", F.lit("")))) >= ready.page_chars


def _scan_sum(column: str) -> Column:
    """The sum over a document's text pages, or over all of its pages if it has none."""
    of = F.col(column).cast("long")
    return F.coalesce(F.sum(F.when(F.col("has_text"), of)), F.sum(of)).alias(column)


def scanned_pages(page_text: DataFrame, *, max_pages: int | None = None, seed: int = 0, ready: readiness.Thresholds = readiness.Thresholds()) -> DataFrame:
    """The pages that a scan reads; with ``max_pages``, no more than so many of a document: those with the smallest
    hashes of seed, document and page, so that a seed gives the same pages every time.
    """
    slim = page_text.select("doc_id", "page_num", _has_text(ready).alias("has_text"))
    own = Window.partitionBy("doc_id")
    chosen = slim.withColumn("any_text", F.max("has_text").over(own)).filter(F.col("has_text") | ~F.col("any_text"))
    if max_pages is not None:
        place = F.md5(F.concat_ws("|", F.lit(seed), "doc_id", "page_num"))
        chosen = chosen.withColumn("place", F.row_number().over(own.orderBy(place, "page_num"))).filter(F.col("place") <= max_pages)
    return page_text.join(chosen.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")


def page_statistics(page_text: DataFrame, at: Quality = Quality(), ready: readiness.Thresholds = readiness.Thresholds()) -> DataFrame:
    """Counts of each page; a page without text counts nothing."""
    text = F.col("text")
    # what several columns need is a column first, so that it is computed once
    pages = page_text.select(
        "doc_id", "rel_path", "page_num", F.coalesce(text, F.lit("")).alias("text"), F.length(text).alias("chars"), t.flat(text).alias("flat"), t.printable(text).alias("printable"),
        F.transform(t.lines(text), lambda line: F.length(t.strip(line)).cast("long")).alias("lengths"),
    )
    zero = F.lit(0).cast("long")
    pages = pages.withColumn("dense", t.solid(F.col("flat")))
    solid = F.length("dense")
    return pages.select(
        "doc_id", "rel_path", "page_num", "text", "chars", t.words(F.col("flat")).alias("words"), F.length(t.without(F.col("dense"), r"\P{L}")).alias("letters"),
        (solid - F.length(t.without(F.col("dense"), t.DIGIT))).alias("digits"), solid.alias("solid"), "printable", t.occurrences(text, "\ufffd").alias("replaced"),
        (solid - F.col("printable") + t.occurrences(text, " ")).alias("control"), t.run_characters(text, at.run).alias("runs"), F.size("lengths").alias("lines"),
        F.aggregate("lengths", zero, lambda a, x: a + x).alias("line_chars"), F.aggregate("lengths", zero, lambda a, x: a + x * x).alias("line_squares"), F.array_distinct(F.split(text, "")).alias("kinds"), _has_text(ready).alias("has_text"),
    )


_SUMMED = ("chars", "words", "letters", "digits", "solid", "printable", "replaced", "control", "runs", "lines", "line_chars", "line_squares")


def _statistic_sums() -> list[Column]:
    filled, with_text = F.col("text") != "", F.count_if("has_text")
    # characters of a page are few kinds, and pages of a document are bounded by its length
    kinds = F.when(with_text > 0, F.collect_list(F.when(F.col("has_text"), F.col("kinds")))).otherwise(F.collect_list(F.when(filled, F.col("kinds"))))
    return [F.when(with_text > 0, with_text).otherwise(F.count_if(filled)).alias("pages"), *map(_scan_sum, _SUMMED), F.size(F.array_distinct(F.flatten(kinds))).alias("kinds")]


def text_quality(page_text: DataFrame, at: Quality = Quality()) -> DataFrame:
    """Sixteen statistics, score and label of each document with text."""
    docs = page_statistics(page_text, at).groupBy("doc_id").agg(*_statistic_sums()).filter("pages > 0")
    return docs.select("doc_id", *_quality_columns(at))


def _quality_columns(at: Quality) -> list[Column]:
    """The columns of text_quality() from the sums of a document."""
    c = F.col
    alpha, digit, printable, runs = _share(c("letters"), c("solid")), _share(c("digits"), c("solid")), _share(c("printable"), c("chars")), _share(c("runs"), c("chars"))
    symbols = F.greatest(c("solid") - (alpha * c("solid")).cast("long") - (digit * c("solid")).cast("long"), F.lit(0))
    marks = (
        (0.35, alpha < at.alpha),
        (0.15, printable < at.printable),
        (0.15, (c("words") < at.gibberish_words) & (c("chars") >= at.empty_chars)),
        (0.15, _share(symbols, c("solid")) > at.symbols),
        (0.10, c("replaced") > 0),
        (0.10, c("control") > 0),
        (0.15, runs >= at.run_share),
    )
    gibberish = F.least(reduce(lambda a, m: a + F.when(m[1], m[0]).otherwise(0.0), marks, F.lit(0.0)), F.lit(1.0))
    mean = _share(c("line_chars"), c("lines"))
    spread = F.sqrt(F.greatest(_share(c("line_squares"), c("lines")) - mean * mean, F.lit(0.0)))
    score = (0.5 * alpha + 0.3 * printable + 0.2 * F.least(c("words") / 200.0, F.lit(1.0))) * (1 - gibberish)
    label = (
        F.when((c("chars") < at.empty_chars) | (c("words") < at.empty_words), "EMPTY")
        .when((gibberish >= at.gibberish) | (alpha < at.alpha) | (printable < at.printable), "LOW")
        .otherwise("GOOD")
    )
    rounded = {
        "avg_chars_per_text_page": _share(c("chars"), c("pages")), "avg_words_per_text_page": _share(c("words"), c("pages")), "alpha_ratio": alpha, "digit_ratio": digit,
        "printable_ratio": printable, "unique_char_ratio": _share(c("kinds"), c("chars")), "avg_line_len": mean, "std_line_len": spread, "repeated_run_score": runs,
        "gibberish_score": gibberish, "text_quality_score": F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)),
    }
    return [
        c("pages").alias("text_pages"), c("chars").alias("total_chars"), c("words").alias("total_words"), *(F.round(e, 6).alias(n) for n, e in rounded.items()),
        c("control").alias("control_char_count"), c("replaced").alias("replacement_char_count"), label.alias("text_quality_label"),
    ]


def quality_summary(quality: DataFrame) -> DataFrame:
    return quality.groupBy("text_quality_label").agg(F.count("*").alias("docs"), F.round(F.avg("text_quality_score"), 6).alias("mean_score"))


def snippets(page_text: DataFrame, at: Quality = Quality()) -> DataFrame:
    """The first page of each document that a scan reads and that is not blank, made safe to show."""
    pages = page_text.filter(t.strip(F.col("text")) != "").withColumn("blank", ~_has_text(readiness.Thresholds()))
    first = pages.groupBy("doc_id").agg(F.min_by("text", F.struct("blank", "page_num")).alias("text"))
    return first.select("doc_id", t.snippet(F.col("text"), at.snippet).alias("text_snippet"))


def _pattern(pattern: str) -> str:
    return "(?Ud)" + pattern


_HITS = tuple(f"{c}__{r}" for c, r, _ in RULES)


def _page_hits() -> list[Column]:
    """Hits of every rule on a page with ``text`` and ``folded``; what a guard rules out is not searched."""
    out, seen = [], {}
    for category, rule, pattern in RULES:
        if pattern not in seen:
            guard = reduce(lambda a, b: a | b, (F.col("folded").contains(g) for g in GUARDS[rule])) if rule in GUARDS else F.col("text").rlike(r"\p{Nd}{4}")
            seen[pattern] = F.when(guard, t.count(F.col("text"), _pattern(pattern))).otherwise(0)
        out.append(seen[pattern].alias(f"{category}__{rule}"))
    return out


def _hit_sums() -> list[Column]:
    """A pattern that two categories share is searched once."""
    of = {}
    return [_scan_sum(of.setdefault(p, f"{c}__{r}")).alias(f"{c}__{r}") for c, r, p in RULES]


def rule_hits(page_text: DataFrame, every_page: bool = False) -> DataFrame:
    """Hits of every rule, and lines, by document; with ``every_page``, of all its pages."""
    pages = page_text.filter("text <> ''").select("doc_id", "text", F.lower(F.upper("text")).alias("folded"))
    counted = F.lit(True) if every_page else _has_text(readiness.Thresholds())
    pages = pages.select("doc_id", counted.alias("has_text"), F.size(t.lines(F.col("text"))).alias("lines"), *_page_hits())
    return pages.groupBy("doc_id").agg(_scan_sum("lines").alias("line_count"), *_hit_sums())


def _type_columns() -> tuple[list[Column], Column, Column]:
    """(scores of the categories, best category, confidence) from hits."""
    scores = {k: reduce(lambda a, b: a + b, [F.col(f"{c}__{r}") for c, r, _ in RULES if c == k]).cast("double") for k in CATEGORIES}
    density = F.greatest(_share(F.col("CONTACT_LIST__email_address"), F.col("line_count")), _share(F.col("CONTACT_LIST__phone_number"), F.col("line_count")))
    scores["CONTACT_LIST"] += F.when(density > 0.3, 3.0).when(density > 0.15, 1.5).otherwise(0.0)
    blanks = F.col("FORM_TEMPLATE__underscore_blank")
    scores["FORM_TEMPLATE"] += F.when(blanks >= 5, 2.0).when(blanks > 0, 0.5).otherwise(0.0)
    best, total = F.greatest(*CATEGORIES), reduce(lambda a, b: a + b, map(F.col, CATEGORIES))
    winner = reduce(lambda rest, k: F.when(F.col(k) == best, k).otherwise(rest), reversed(CATEGORIES), F.lit(None))
    return [e.alias(k) for k, e in scores.items()], F.when(best > 0, winner).otherwise("OTHER_TEXT"), F.when(best > 0, F.round(best / total, 6)).otherwise(0.0)


def content_type(hits: DataFrame) -> DataFrame:
    """Best category by hits and densities, ties to the first; its share of all scores is the confidence."""
    scores, kind, confidence = _type_columns()
    return hits.select("doc_id", *scores).select("doc_id", kind.alias("content_type_pred"), confidence.alias("content_type_confidence"))


def signals_json(hits: DataFrame) -> DataFrame:
    """What led to a type, as JSON with sorted keys: hits of each rule by category, and line, e-mail, phone and blank counts."""
    by = F.struct(*(F.struct(*(F.col(f"{k}__{r}").alias(r) for r in sorted(r for c, r, _ in RULES if c == k))).alias(k) for k in sorted(CATEGORIES)))
    stats = F.struct(
        F.col("CONTACT_LIST__email_address").alias("email_address_count"), F.col("line_count").alias("line_count"),
        F.col("CONTACT_LIST__phone_number").alias("phone_number_count"), F.col("FORM_TEMPLATE__underscore_blank").alias("underscore_runs"),
    )
    return hits.select("doc_id", F.to_json(F.struct(by.alias("rule_hits"), stats.alias("stats"))).alias("content_type_signals"))


def document_signals(page_text: DataFrame, at: Quality = Quality(), ready: readiness.Thresholds = readiness.Thresholds(), every_page: bool = False) -> DataFrame:
    """Readiness, quality and type of each document from one projection of its pages and one shuffle.

    Columns of readiness.docs(), text_quality() and content_type(); the latter two are null without text. With
    ``every_page``, quality and type are those of all pages that are not empty.
    """
    pages = page_statistics(page_text, at, ready).withColumn("folded", F.lower(F.upper("text")))
    pages = pages.select("doc_id", "rel_path", "text", "kinds", *_SUMMED, F.length(t.strip(F.col("text"))).alias("text_char_count"), "has_text", *_page_hits())
    pages = pages.withColumn("ready", F.col("has_text"))
    if every_page:
        pages = pages.withColumn("has_text", F.col("text") != "")
    docs = pages.groupBy("doc_id", "rel_path").agg(
        F.count("*").alias("page_count"), F.count_if("ready").alias("pages_with_text"), F.sum(F.col("text_char_count").cast("long")).alias("total_text_chars"),
        _scan_sum("lines").alias("line_count"), *_statistic_sums(), *_hit_sums(),
    )
    share, average = F.col("pages_with_text") / F.col("page_count"), F.col("total_text_chars") / F.col("page_count")
    scores, kind, confidence = _type_columns()
    found = docs.select("*", *scores).select(
        "doc_id", "rel_path", "page_count", "pages_with_text", "total_text_chars", F.round(average, 6).alias("avg_text_chars_per_page"), F.round(share, 6).alias("text_coverage_pct"),
        readiness.classify(share, average, F.col("page_count"), ready).alias("classification"), *_quality_columns(at), kind.alias("content_type_pred"), confidence.alias("content_type_confidence"),
    )
    of_text = [c for c in found.columns[8:] if c != "text_pages"]
    return found.select(*found.columns[:9], *(F.when(F.col("text_pages") > 0, F.col(c)).alias(c) for c in of_text))


def scanned(signals: DataFrame, min_text_pages: int = 1) -> DataFrame:
    """The documents that a text scan takes: those with pages enough that have text. None at all is an error."""
    rows = staged(signals.filter(F.coalesce("pages_with_text", F.lit(0)) >= min_text_pages), "scanned")  # scanned once, then looked at
    if rows.isEmpty():
        raise ValueError(f"no document has {min_text_pages} pages with text")
    return rows


def merge_signals(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """docs with the four signal columns of the row with the same path (the least doc_id of several)."""
    cols = ("text_quality_label", "text_quality_score", "content_type_pred", "content_type_confidence")
    one = signals.groupBy("rel_path").agg(F.min_by(F.struct(*cols), "doc_id").alias("s")).select("rel_path", *(F.col(f"s.{c}") for c in cols))
    return docs.join(one, "rel_path", "left")


def merge_coverage(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """Distinct paths of docs, those with signals, their share, and why nothing is merged where that is so."""
    left, right = docs.select("rel_path").distinct(), signals.select("rel_path").distinct().withColumn("found", F.lit(1))
    counts = left.join(right, "rel_path", "left").agg(F.count("*").alias("paths"), F.count("found").alias("merged"))
    reason = F.when(F.col("merged") == 0, "no path in common")
    return counts.select("paths", "merged", F.round(_share(F.col("merged"), F.col("paths")), 6).alias("coverage"), reason.alias("unmerged_reason"))


def merge_if_same_run(docs: DataFrame, signals: DataFrame, probe_run: str | None, scan_of_run: str | None) -> DataFrame:
    """merge_signals(), unless the scan says that it was made of another probe run: then no signals."""
    other = bool(probe_run and scan_of_run and probe_run != scan_of_run)
    return merge_signals(docs, signals.limit(0) if other else signals)
