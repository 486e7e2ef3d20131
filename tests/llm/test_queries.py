"""Every query of the text operators runs on whole tables; those with SQL equal it."""

import os

import oracle
import pytest

from sonmai.llm import queries

D = f"{oracle.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
COLUMNS = {
    "p1_found": ["label_id_a", "label_id_b"], "p2_found": ["label_id", "forced"], "p3_found": ["label_id", "kind"], "p4_found": ["id_a", "id_b"], "p5_found": ["label_id", "field"], "p6_found": ["label_id", "field", "ref_id"],
    "p7_found": ["field", "name_a", "name_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs(spark, name):
    t = queries.QUERIES[name](spark, D)
    rows = t.collect()
    if name in COLUMNS:
        assert t.columns == COLUMNS[name]
        assert len({repr(r) for r in rows}) == len(rows)
    if name == "p8_roundtrip":
        assert all(r.same for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_equals_sql(spark, name):
    assert oracle.difference(spark, oracle.connect(D), D, queries.QUERIES[name], queries.ORACLE[name]) is None
