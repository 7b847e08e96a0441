"""The recoding query covers every item with pages."""

import duckdb

import __spark_entry__ as entry
from folio.plans.formats import item_rasters
from folio.plans.pages import PAGES_SQL


def test_every_item_is_recoded(spark, data):
    c = duckdb.connect()
    for n in ("scandata_pages", "page_geometry", "embeddings"):
        c.execute(f"create view {n} as select * from '{data}/{n}.parquet'")
    rows, pages = c.execute("select count(*) from embeddings").fetchone()[0], f"{PAGES_SQL} SELECT p.doc, p.idx FROM p JOIN page_geometry g ON p.doc = g.doc AND p.idx = g.page_idx WHERE g.imwidth > 0 AND coalesce(p.add_to_access, '') != 'false'"
    strips = (rows + 24) // 25
    want: dict = {}
    for doc, idx in c.execute(f"WITH {pages}").fetchall():
        strip = (doc + idx) % strips
        n, size = want.get(doc, (0, 0))
        want[doc] = n + 1, size + min(25, rows - strip * 25) * 4 * 256
    got = {r.doc: (r.pages, r.source_bytes) for r in entry.queries()["recoded"](spark, data).collect()}
    assert got == want and len(want) > 1 and 1 in want
    assert item_rasters(spark, data).count() == c.execute("select count(*) from (select distinct doc, page_idx from page_geometry)").fetchone()[0]
