"""Queries against their SQL on the smallest tables, where these are at hand."""

import os
from decimal import Decimal

import pytest

DATA = os.environ.get("TRIAGO_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
CHEAP = ("keyword_verdicts", "title_scores", "rule_a_decision", "title_zone", "compact_text", "truncate_prompt", "normalize_amount", "mask_customers", "name_collisions", "dedupe_by_fingerprint", "page_ocr_merge", "status_listing", "retention_filter", "last_event_by_run", "latest_state", "free_fields_asked", "review_records")


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else None if value != value else str(value) if value is not None else None


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from triago.plans import catalog

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    sql = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    wanted = sorted(repr([plain(r[names.index(n)]) for n in sorted(names)]) for r in sql.fetchall())
    df = catalog.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[n]) for n in sorted(names)]) for r in df.collect()) == wanted


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_mask_summary_keeps_long_numbers(spark, tmp_path):
    from triago.plans import catalog

    spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, timestamp'2026-01-02' AS o_orderdate FROM values (7L), (9999999L), (10000000L), (123456789L) AS t(id)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(str(tmp_path / "orders.parquet")).selectExpr("o_orderkey AS l_orderkey", "10.0D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1L AS c_custkey, 'x' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.doc_id: r.numero for r in catalog.mask_field_summary(spark, str(tmp_path)).collect()}
    assert got == {7: "FA-7", 9999999: "FA-9999999", 10000000: "FA-[MASQUÉ]", 123456789: "FA-[MASQUÉ]"}


def test_masked_text_equals_sql_on_odd_texts(spark, tmp_path):
    """Numbers that a phone's form joins, words and letters beside numbers, nulls."""
    duckdb = pytest.importorskip("duckdb")
    from triago.plans import catalog

    texts = [
        "call (969) 555-0612 53.12.34.56 now", "0612345678 12", "06-12-34-56-78", "ma 12345 67890 12", "+212 6 12 34 56 78", "a CIN", "cin : ab 12", "carte nationale x", "éa12345 a12345é ab12345_", "AB 12345 À 12345",
        "1 123456789012345678901234 5", "١٢٣٤٥٦٧٨", "x.y+z@été-b.c_d.+u@v.w", "@a.b a@b", "", None,
    ]
    rows = [(i + 16 * j, t, s) for j, s in enumerate(("s", "n1@exemple.ma", None)) for i, t in enumerate(texts)] + [(-4, "t", "s"), (-5, "t", "s"), (10**9 + 6, "t", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'fr' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = sorted(con.execute(catalog.oracle_sql()["mask_text"]).fetchall(), key=lambda r: r[0])
    got = sorted(((r.doc_id, r.had_email, r.masked) for r in catalog.mask_text(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == wanted
