"""Queries with SQL against it; all others for their columns."""

import pytest

from lexaria.llm import queries

FOUND = {
    "p1_found": ["doc_id", "termino"], "p2_found": ["doc_id", "seg", "idioma"], "p3_found": ["doc_id", "kind", "content"], "p4_found": ["doc_id", "linea"], "p5_found": ["marca", "clave"],
    "p7_found": ["campo", "id_a", "id_b"], "p8_found": ["doc_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, oracle, name):
    oracle(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
