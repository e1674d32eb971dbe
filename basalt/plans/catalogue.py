"""All queries by name, with the SQL each is held against."""

from __future__ import annotations

from basalt.plans import business, gold_queries, operators, surface, warehouse

QUERIES: dict = {**business.QUERIES, **operators.QUERIES, **warehouse.QUERIES, **gold_queries.QUERIES, **surface.QUERIES}
ORACLES: dict = {**business.ORACLES, **operators.ORACLES, **warehouse.ORACLES, **gold_queries.ORACLES, **surface.ORACLES}
