"""All measurement queries and their DuckDB counterparts."""

from __future__ import annotations

from assayframe.plans import charts, derived, display, filters, measurements, reading, views, work
from assayframe.sources.model import MODEL_SQL

MODULES = (measurements, derived, filters, views, work, display, reading, charts)
QUERIES: dict = {name: getattr(plans, name) for plans in MODULES for name in plans.SQL}
#: What a query's SQL needs besides the model.
WITH = {"extract_diff": derived.DIFF}
ORACLES: dict = {name: MODEL_SQL + measurements.EXTRA + WITH.get(name, "") + sql for plans in MODULES for name, sql in plans.SQL.items()}
