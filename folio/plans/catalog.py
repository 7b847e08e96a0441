"""All queries over the tables of scanned items, and the SQL each is compared with."""

from folio.plans import formats, metrics, pages, raster, text

MODULES = (pages, metrics, text, raster, formats)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
