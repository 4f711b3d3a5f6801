"""Every core query against its SQL."""

import pytest

from lexaria.plans import retrieval_queries, skew_queries, text_queries, web_queries

MODULES = (skew_queries, text_queries, retrieval_queries, web_queries)
CASES = [(k, m) for m in MODULES for k in m.SQL]


@pytest.mark.parametrize("name,module", CASES, ids=[c[0] for c in CASES])
def test_same_rows(spark, oracle, name, module):
    oracle(spark, module.QUERIES[name], module.SQL[name])


def test_every_sql_has_a_query():
    for m in MODULES:
        assert set(m.SQL) <= set(m.QUERIES)
