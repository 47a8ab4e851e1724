"""Column functions on page text: character classes, lines, snippets.

Java's classes stand for Python's notions of space, letters and digits; all patterns are Unicode-aware and
break lines at newlines only where a rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.rules import EMAIL

SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}"
#: The same characters, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LETTER = r"\p{L}"
DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: What a snippet hides, with the rules' e-mail pattern.
LONG_NUMBER = r"\b\d{5,}\b"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Lines as an array: a break at the end opens no further line, an empty text has none."""
    parts = F.split(text, BREAK, -1)
    closed = text.rlike(rf"({BREAK})\z")
    return F.when(text == "", F.array().cast("array<string>")).when(closed, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def without(text: Column, kind: str) -> Column:
    """The text without a class of characters: what is left is counted by its length, without an array of matches."""
    return F.regexp_replace(text, f"[{kind}]+", "")


def flat(text: Column) -> Column:
    """Every run of spaces as one space."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def solid(flattened: Column) -> Column:
    """Of a flat text, what is no space."""
    return F.replace(flattened, F.lit(" "), F.lit(""))


def words(flattened: Column) -> Column:
    """Runs of anything but space in a flat text."""
    inner = F.trim(flattened)
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(solid(inner)) + 1)


def printable(text: Column) -> Column:
    return F.length(without(text, r"\p{C}\p{Z}&&[^\x20]"))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def run_characters(text: Column, least: int) -> Column:
    """Characters in runs of at least ``least`` of one mark (no letter, digit or space)."""
    runs = F.regexp_extract_all(text, F.lit(rf"([^{SPACE}\p{{L}}\p{{N}}])\1{{{least - 1},}}"), F.lit(0))
    return F.aggregate(runs, F.lit(0), lambda total, run: total + F.length(run))


def snippet(text: Column, size: int = 200) -> Column:
    """One line without e-mail addresses and long numbers, cut at ``size`` characters."""
    flat = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    masked = F.regexp_replace(F.regexp_replace(flat, f"(?Ui){EMAIL}", "[email]"), f"(?U){LONG_NUMBER}", "[number]")
    return F.when(F.length(masked) <= size, masked).otherwise(F.concat(F.rtrim(F.substring(masked, 1, size)), F.lit("…")))


def literal(keyword: str) -> str:
    """A pattern for exactly this keyword."""
    return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in keyword)
