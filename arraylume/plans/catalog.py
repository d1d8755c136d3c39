"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from arraylume.plans import catalog_arrays, catalog_images

QUERIES: dict = {**catalog_arrays.CATALOG.queries, **catalog_images.CATALOG.queries}
ORACLE: dict = {**catalog_arrays.CATALOG.oracle, **catalog_images.CATALOG.oracle}
FLAGSHIP = "flagship_revenue"
