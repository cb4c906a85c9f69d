"""Queries that once read a part of their tables leave no row out."""

from __future__ import annotations

from hemiciclo.plans import queries

SF = "/root/testdata/sf0.001"


def test_vote_sheets_of_every_order(spark):
    sheets, orders = queries.QUERIES["vote_sheets"](spark, SF), queries.read(spark, SF, "orders")
    assert sorted(r.doc for r in sheets.collect()) == sorted(r.o_orderkey for r in orders.collect())


def test_every_part_is_a_wanted_name(spark):
    found = {(r.p_partkey, r.p_type) for r in queries.QUERIES["token_subset_join"](spark, SF).collect()}
    assert {(r.p_partkey, r.p_type) for r in queries.read(spark, SF, "part").collect()} <= found


def test_every_vector_has_a_box(spark):
    found = queries.QUERIES["containment_argmin"](spark, SF)
    assert found.count() == queries.read(spark, SF, "embeddings").where("label is not null").count() == found.where("box_id is not null").count()


def test_every_document_is_expected(spark):
    assert queries.QUERIES["reconcile"](spark, SF).first()["expected"] == queries.read(spark, SF, "documents").select("doc_id").distinct().count()


def test_customers_of_every_id_and_balance(spark):
    found = {r.c_custkey for r in queries.QUERIES["domain_filter"](spark, SF).collect()}
    left_out = {r.c_custkey for r in queries.read(spark, SF, "customer").where("c_mktsegment = 'BUILDING' and c_custkey % 7 = 0 and c_acctbal >= 0 and (c_custkey % 3 = 0 or c_custkey % 15 >= 13)").collect()}
    assert left_out and left_out <= found


def test_scanned_amounts_is_one_narrow_pass(spark):
    """A join of its lines and blocks was sent to the driver, which had no memory for it at 60 times sf0.1."""
    found = queries.QUERIES["scanned_amounts"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert found.count() == 4 * queries.read(spark, SF, "part").count()
