"""Every query of the subpackage runs over the small tables and gives no row twice."""

import pytest

import __spark_entry__ as entry
from folio.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, data):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
        assert df.columns == {"p1": ["doc_id", "line_no"], "p2": ["doc", "page_idx", "line", "kind"], "p3": ["doc_id", "lang"], "p4": ["doc_id", "kind"], "p5": ["doc_id", "end_pos"], "p7": ["doc_id", "item_id"], "p8": ["doc_id"]}[name[:2]]
