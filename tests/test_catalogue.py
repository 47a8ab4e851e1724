import pytest

from folioforge import catalogue

from .conftest import TABLES


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_model_predicts_every_pdf(spark):
    rows = catalogue.QUERIES["doc_type_model"](spark, TABLES).collect()
    labels = ("TEXT_PDF", "IMAGE_OF_TEXT_PDF", "IMAGE_PDF", "MIXED_PDF")
    assert len(rows) > 100
    for r in rows:
        p = [r[f"proba_{k}"] for k in labels]
        assert abs(sum(p) - 1) < 1e-9 and r.confidence == max(p) and r.predicted_label == labels[p.index(max(p))] and r.proba_TEXT_PDF == 0
        assert r.reason_features.count(":") == 5
