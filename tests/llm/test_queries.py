import pytest

from casegrid.llm import language
from casegrid.llm.queries import QUERIES

COLUMNS = {
    "p2_found": ["source_table", "record_id", "pii_type", "pii_value"], "p3_found": ["case_id", "name_a", "name_b"], "p5_found": ["source_table", "record_id", "noise_kind", "found"],
    "p6_found": ["msg_id", "lang"], "p7_found": ["case_id", "app", "party_a", "party_b", "first_msg_id", "n_messages"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"p6_found", "p10_found"}))
def test_rows_and_columns(name, spark, data):
    rows = QUERIES[name](spark, data)
    assert rows.columns == COLUMNS.get(name, rows.columns)
    found = rows.collect()
    assert found and (not name.endswith("_found") or len(set(found)) == len(found))


def test_language_on_the_smallest_tables(spark, data):
    """Segments of the query's own operator, with a short training."""
    few = language.Settings(updates=(60, 60, 60), batch=64)
    rows = language.p6_found(spark, data, few)
    assert rows.columns == COLUMNS["p6_found"] and set(r.lang for r in rows.collect()) <= set(language.LANGUAGES)


def test_reading_on_the_smallest_tables(spark, data):
    rows = QUERIES["p10_found"](spark, data)  # they hold a dozen graded documents, too few for a model that must find any
    assert rows.columns == COLUMNS["p10_found"] and rows.count() == rows.distinct().count()


def test_containers_of_the_tables_are_full(spark, data):
    rows = {r.spec_name: r for r in QUERIES["p8_fill"](spark, data).collect()}
    assert all(r.used > 0.75 and r.used_loss <= 1 and r.used_segments <= 1 for r in rows.values()) and len(rows) == 3
