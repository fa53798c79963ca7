import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


def test_every_query_has_a_stable_schema(spark, sf):
    for name in ("p2_found", "p5_found", "event_to_text", "vector_topk", "verify_summary"):
        assert entry.queries()[name](spark, sf).columns


def test_found_columns(spark, sf):
    want = {"p2_found": ["event_id", "field_name", "paise"], "p5_found": ["event_id", "field_name", "normal_form"]}
    for name, columns in want.items():
        assert entry.queries()[name](spark, sf).columns == columns
