"""Registered queries over whole tables, against their SQL in duckdb."""

import pytest

from thicket import catalog

SF = "/root/testdata/sf0.001"


def compare(spark, name, sf_dir=SF):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect())
    assert got == sorted(c.execute(catalog.ORACLES[name]).fetchall())
    return [r[0] for r in got]


@pytest.mark.parametrize("name", ["decode_bytes", "function_string_value", "edit_documents", "include_resources", "parse_errors", "canonical_digest"])
def test_no_document_is_left_out(spark, name):
    of, key = ("pages", "page_id") if name == "decode_bytes" else ("orders", "o_orderkey")
    assert compare(spark, name) == sorted(r[0] for r in catalog.table(spark, SF, of).select(key).collect())


@pytest.mark.parametrize("name", ["canonical_digest", "edit_documents", "functions_on_numbers", "function_string_join", "path_attribute_nodes"])
def test_nodes_of_documents_are_not_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Exchange hashpartitioning" not in plan


def test_included_resources_are_not_broadcast_by_the_size_of_their_files(spark):
    from thicket.storage import bucketed

    nodes = bucketed(spark.range(300000).selectExpr("id % 2 AS doc_id", "cast(id AS int) AS pre", "'x' AS content").repartition(2, "doc_id"), "doc_id", 2)
    size = int(str(nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 300000 * 12


def test_levels_of_a_grammar_are_not_shuffled(spark, monkeypatch):
    from thicket.operators import grammar, schemas
    from thicket.storage import bucketed

    plans = []

    def kept(df, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return bucketed(df, *how)

    monkeypatch.setattr(grammar, "bucketed", kept)
    nodes = catalog.order_nodes(spark, SF)
    types = grammar.element_types(nodes, schemas.relax_ng(catalog.ORDER_RNG), catalog.order_buckets(spark, SF))
    assert len(plans) == 4 and not any("Exchange hashpartitioning" in p for p in plans)
    assert types.count() == nodes.filter("kind = 'element'").count()


def test_values_of_pages_and_orders_are_those_of_the_sql(spark, tmp_path):
    spark.sql("SELECT 1L AS page_id, 'u' AS url, '<html><head><title>a &amp</title></head><body><h1>b&amp; c&lt</h1><a href=\"x\">y</a></body></html>' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_heading_text", "pages_title_and_links"):
        assert [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == c.execute(catalog.ORACLES[name]).fetchall()


@pytest.mark.parametrize("name", ["predicate_having_and_without", "functions_on_numbers", "axis_parent", "function_string_join"])
def test_string_values_take_no_joins(spark, name):
    assert "t_pre" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_orders_are_not_escaped_and_writers_are_set_back(spark):
    from thicket.storage import bucketed

    plan = catalog.order_docs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(cast(l_partkey" not in plan and "replace(cast(l_extendedprice" not in plan and "replace(" in plan
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "3")
    try:
        made = bucketed(spark.range(100).repartition(4, "id"), "id", 4)
        assert len(made.inputFiles()) == 4 and made.count() == 100 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3"
    finally:
        spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")


def test_documents_without_declarations_are_put_together_without_joins(spark):
    plan = catalog.QUERIES["canonical_digest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and "Exchange hashpartitioning" not in plan


def test_edits_by_conditions_are_one_pass(spark, monkeypatch):
    plans, was = [], catalog.bucketed
    nodes = catalog.order_nodes(spark, SF)

    def kept(df, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return was(df, *how)

    monkeypatch.setattr(catalog, "bucketed", kept)
    catalog.QUERIES["edit_documents"](spark, SF)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "Join" not in plans[0] and "Exchange hashpartitioning" not in plans[0]
