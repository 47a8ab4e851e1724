"""Features of transcripts: one row a recording from a table of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import count, literal

#: Patterns counted in transcripts.
PATTERNS = (
    ("email_count", r"(?i)\b[\w\.-]+@[\w\.-]+\.\w+\b"),
    ("phone_count", r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"),
    ("url_count", r"(?i)https?://\S+|www\.\S+"),
    ("date_like_count", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"),
)
#: Names of hints at a recording's structure, and their patterns.
HINTS = (
    ("email_headers", r"(?i)\b(from:|subject:|to:)\b"),
    ("case_number", r"(?i)\b(case\s+number|ticket\s+number)\b"),
    ("invoice", r"(?i)\binvoice\b"),
    ("thank_you", r"(?i)\bthank you for calling\b"),
)


def features(segments: DataFrame, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Counts of each recording: segments, speakers, words, patterns; hints found; keywords by category, and the
    five most frequent terms that occur, of equal ones the first given. No keywords are looked for by default.
    """
    keywords = keywords or {}
    text = F.lower("text")
    terms = list(dict.fromkeys(term for own in keywords.values() for term in own))

    def hits(term: str) -> Column:
        return count(text, rf"(?U)\b{literal(term.lower())}\b")

    sums = [F.sum(count(F.col("text"), "(?U)" + p)).alias(n) for n, p in PATTERNS]
    sums += [F.max(text.rlike("(?U)" + p)).alias(f"hint_{n}") for n, p in HINTS]
    sums += [F.sum(hits(term)).alias(f"term_{i}") for i, term in enumerate(terms)]
    by = segments.groupBy("conv_id").agg(F.count("*").alias("num_segments"), F.countDistinct("role").alias("num_speakers"), F.sum(count(text, r"(?U)\b\w+\b")).alias("word_count"), *sums)
    hints = F.array_compact(F.array(*(F.when(F.col(f"hint_{n}"), n) for n, _ in HINTS)))
    of = {term: F.col(f"term_{i}") for i, term in enumerate(terms)}
    each = [F.struct((-of[term]).alias("n"), F.lit(i).alias("given"), F.lit(term).alias("term")) for i, term in enumerate(terms)]
    ranked = F.array_sort(F.filter(F.array(*each), lambda k: k["n"] < 0)) if each else None
    top = F.transform(F.slice(ranked, 1, 5), lambda k: k["term"]) if each else F.array().cast("array<string>")
    categories = [sum((of[term] for term in own), F.lit(0)).alias(f"category_{c}") for c, own in keywords.items()]
    return by.select("conv_id", "num_segments", "num_speakers", "word_count", *(n for n, _ in PATTERNS), hints.alias("structure_hints"), *categories, top.alias("top_keywords"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """Segments of a recording in order, as one text: ``speaker: text`` lines where the speaker is known."""
    line = F.concat(F.when(F.coalesce("role", F.lit("")) != "", F.concat("role", F.lit(": "))).otherwise(""), F.trim(F.coalesce("text", F.lit(""))))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("transcript"))
