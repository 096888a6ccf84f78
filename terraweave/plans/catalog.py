"""Registry of the queries outside the subpackage llm."""

from __future__ import annotations

from terraweave.plans import clouds, jobs, photos, regions, series

QUERIES: dict = {}
ORACLE: dict = {}
FLAGSHIP = "a22_top_views"

for _family in (clouds, photos, regions, series, jobs):
    QUERIES |= _family.QUERIES
    ORACLE |= _family.ORACLE
