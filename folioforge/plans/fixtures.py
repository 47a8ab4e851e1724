"""Literal rows for rules that the test tables never meet: the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (document id, text of a page)
RULE_PAGES = (
    (-1, "From: Ann\nTo: Bob\nSubject: plans\n\n-- Original Message --\nmeet 10:30 am on 1/2/2024 ann@example.com"),
    (-2, "IN THE DISTRICT COURT\nCase No. 12\nPlaintiff v. Defendant\nDocket of motions: affidavit and motion"),
    (-3, "Dear Sir\nplease find enclosed\nSincerely\nC. Doe\nDate: today"),
    (-4, "Invoice: payment of $ 50 by wire to the account, 20 USD, amount due"),
    (-5, "ann@example.com\nbob@example.com 555-123-4567\n(555) 123-4567"),
    (-6, "Name: ____ Date: ____\n[ ] yes [] no ☐\n____ ____ ____ ____"),
    (-7, "nothing of note here"),
)

#: (query) for name lookups
NAME_QUERIES = ("Aich Aich", "and and", "and, and", "ai", " ")

def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def rule_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, "", 1, t) for d, t in RULE_PAGES], "doc_id long, rel_path string, page_num int, text string")

