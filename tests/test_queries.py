"""Every registered query: against its SQL where there is one, else rows and a stable schema."""

import pytest

import __spark_entry__
from siltstone.plans import registry
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same_rows(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, sf, name):
    a = registry.queries()[name](spark, sf)
    assert a.count() > 0
    assert a.schema == registry.queries()[name](spark, sf).schema


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_only_what_is_asked(spark, sf, capsys):
    registry.queries()["search_hydrated"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "c_acctbal" not in plan and "TakeOrderedAndProject" in plan
    registry.queries()["lookup_by_id"](spark, sf).explain("formatted")
    assert "EqualTo(doc_id,42)" in capsys.readouterr().out


def test_all_documents_are_embedded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(trim(text)) > 0").select("doc_id").distinct()
    embedded = registry.queries()["embed_chunks"](spark, sf).select("doc_id").distinct()
    assert docs.join(embedded, "doc_id", "left_anti").count() == 0
