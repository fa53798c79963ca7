import __spark_entry__ as entry

FOUND = {
    "p1_found": [("lead_id", "bigint"), ("page_from_id", "bigint"), ("price_from_id", "bigint")],
    "p3_found": [("keep_id", "bigint"), ("copy_id", "bigint")],
    "p4_found": [("record_id", "bigint")],
    "p6_found": [("event_id", "bigint"), ("field_name", "string"), ("term_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint"), ("subject_id", "bigint")],
}


def test_found_columns(spark, sf):
    for name, columns in FOUND.items():
        assert entry.queries()[name](spark, sf).dtypes == columns


def test_main_query_of_each_problem_comes_first():
    names = [n for n in entry.queries() if n.startswith("p") and n[1].isdigit()]
    first = {}
    for n in names:
        first.setdefault(n[1], n)
    assert first["7"] == "p7_packing" and all(v.endswith("_found") for k, v in first.items() if k != "7")
