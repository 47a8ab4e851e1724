"""The name queries on made rows that the test tables never hold, against their SQL."""

import json

import duckdb
import pytest

from folioforge import catalogue, cli
from folioforge.operators import names
from folioforge.queries.names import published
from folioforge.sources import tables

from .conftest import normal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def agrees(spark, tmp_path):
    """Runs a query and its SQL over made documents: their rows, which must be the same."""

    def check(name: str, documents: list[tuple]) -> list[tuple]:
        at = str(tmp_path / "documents.parquet")
        spark.createDataFrame([(*d, len(d[1])) for d in documents], SCHEMA).coalesce(1).write.mode("overwrite").parquet(at)
        with duckdb.connect() as con:
            con.sql(f"create view documents as select * from '{at}/*.parquet'")
            relation = con.sql(catalogue.ORACLES[name])
            expected = sorted(tuple(map(normal, row)) for row in relation.fetchall())
            found = catalogue.QUERIES[name](spark, str(tmp_path)).select(*relation.columns).collect()
        assert sorted(tuple(map(normal, row)) for row in found) == expected
        return expected

    return check


def test_mentions_of_a_repeated_id_are_counted_together(agrees):
    documents = [(1, "we met John Smith", "en", "src1"), (1, "and John Smith", "en", "src2"), (2, "saw John Smith", "en", "src1")]
    assert agrees("name_mentions", documents) == [("smith|john", "1", "1", "2"), ("smith|john", "2", "1", "1")]


def test_a_name_under_several_paths_counts_once_for_the_bound(agrees):
    three = "Ann Lee; Bob Ray; Cy Poe"
    documents = [(1, three, "en", "src1"), (1, three, "en", "src2"), (2, three + "; Di Fox; Ed Orr; Flo Ivy", "en", "src1")]
    assert agrees("name_index_capped", documents) == [("lee|ann", "2", "2"), ("poe|cy", "2", "2"), ("ray|bob", "2", "2")]


@pytest.mark.parametrize("name", ["name_index", "name_lookup", "name_search", "name_index_of_good_documents", "name_flatten", "name_summary", "public_name_index"])
def test_documents_of_many_names_are_indexed(agrees, name):
    """More than 500 names, which the operator's default bound leaves out."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = "; ".join(f"An{a} Ran{b}" for a in letters for b in letters)
    rows = agrees(name, [(1, f"{many}; Aich Aich", "en", "src1"), (2, "seen with Ana Rana, as they said in court that day, and no other person was there", "en", "src1")])
    assert {"name_lookup": 2, "name_search": 1, "name_summary": 1, "name_flatten": 678, "name_index_of_good_documents": 678}.get(name, 677) == len(rows)


@pytest.mark.parametrize("name", ["name_index", "name_search", "name_flatten", "public_name_index", "crowded_documents", "name_index_of_good_documents"])
def test_documents_without_a_source_have_no_path_and_come_last(agrees, name):
    said = " was seen there with a friend, as they said in court that day, and no other person was with them"
    documents = [(1, "Anna B. Rana" + said, "en", None), (2, "Anna C. Rana" + said, "en", "src1"), (3, "Anna Rana" + said, None, "src0"), (4, "Al Bo; Cy De; Ed Fo; Gi Hu; Ik Jo; Ka Lu", None, "src0")]
    rows = agrees(name, documents)
    assert name not in ("name_index", "name_search", "public_name_index") or "Anna C. Rana" in rows[-1 if name != "name_search" else 0]


@pytest.mark.parametrize("name", ["name_index_of_good_documents", "document_metadata", "merge_text_signals", "merge_of_same_run"])
def test_quality_of_a_repeated_id_is_that_of_all_its_rows(agrees, name):
    good = "Ann Lee was seen there with a friend, as they said in court that day, and no other person was with them"
    documents = [(1, good, "en", "src1"), (1, "Bob Ray " + "1234567890 " * 60, "en", "src2"), (2, good, "en", "src1"), (2, "Cy Poe", "en", "src2"), (3, good, "en", "src1"), (3, good, "en", "src1")]
    assert len(agrees(name, documents)) == {"name_index_of_good_documents": 3, "document_metadata": 2}.get(name, 6)


def test_nothing_is_left_out_unless_a_bound_is_given(spark, tmp_path):
    """A document of more than 500 names, which the reference leaves out by default."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = spark.createDataFrame([("1", "a", 1, "; ".join(f"An{a} Ran{b}" for a in letters for b in letters)), ("2", "b", 1, "Al Bo")], "doc_id string, rel_path string, page_num int, text string")
    assert names.name_documents(names.mentions_of(pages)).count() == 677
    pages.write.parquet(str(tmp_path / "pages"))
    run = ["name-index", "run", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "o"), "--probe", "NONE", "--label"]
    for label, bound, n in (("all", [], 677), ("few", ["--max-names-per-doc", "500"], 1)):
        cli.main([*run, label, *bound])
        assert spark.read.parquet(tables.resolve_run(spark, str(tmp_path / "o"), "name-index")).count() == n


def test_every_path_left_out_is_listed(spark):
    """Two paths of an id have too many names together, neither alone."""
    rows = [(1, "a", 1, "John Smith"), (1, "b", 1, "Jane Roe"), (2, "c", 1, "John Smith"), (None, None, 1, "Al Bo; Cy De")]
    mentions = names.mentions_of(spark.createDataFrame(rows, "doc_id long, rel_path string, page_num int, text string"))
    assert {r.doc_id for r in names.name_documents(mentions, 1).collect()} == {2}
    assert {(r.doc_id, r.rel_path) for r in names.crowded_documents(mentions, 1).collect()} == {(1, "a"), (1, "b"), (None, None)}
    assert {(r.doc_id, r.rel_path) for r in names.crowded_documents(mentions, 1, each_path=True).collect()} == {(None, None)}


def test_public_records_say_what_is_known_of_each_document(agrees, spark, tmp_path):
    good = "Ann Lee was seen there with a friend, as they said in court that day, and no other person was with them. "
    documents = [(1, good, "en", "src1"), (1, good * 12, "en", "src2"), (1, good, "en", "src2"), (7, "Ann Lee", "en", "src1"), (10, "Ann B. Lee", "en", None), (9, "Ann C. Lee", "en", None), (None, "Ann Lee", "en", "src1"), (None, "Ann Lee", "en", "src1")]
    assert agrees("public_name_index", documents) == [("lee|ann", "Ann Lee", "6")]
    (record,) = published(spark, str(tmp_path)).collect()
    docs = json.loads(record.docs_json)
    fields = {"doc_id", "rel_path", "page_count", "document_url", "doc_type_final", "content_type", "title", "pages", "total_count"}
    assert all(d.keys() == fields for d in docs)
    assert sorted((str(d["doc_id"]), str(d["rel_path"]), str(d["page_count"]), str(d["title"]), str(d["content_type"]), str(d["total_count"])) for d in docs) == [
        ("1", "VOL00001/en/doc_1.pdf", "1", "doc_1.pdf", "LEGAL_PROCEEDING", "1"), ("1", "VOL00002/en/doc_1.pdf", "3", "doc_1.pdf", "LEGAL_PROCEEDING", "13"), ("10", "None", "1", "None", "None", "1"),
        ("7", "VOL00001/en/doc_7.csv", "1", "doc_7.csv", "None", "1"), ("9", "None", "1", "None", "None", "1"), ("None", "None", "None", "None", "None", "2"),
    ]
