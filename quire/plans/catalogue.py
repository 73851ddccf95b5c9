"""All core queries with their SQL."""

from __future__ import annotations

from quire.operators import units
from quire.plans import analysis, document, inquiry, retrieve, structure
from quire.sources.tables import table

PARTS = [retrieve, document, analysis, inquiry, structure]


def p1_found(spark, root):
    return units.found(table(spark, root, "results"), table(spark, root, "metric_units"))


def p1_measured(spark, root):
    return units.measured(table(spark, root, "results"), table(spark, root, "metric_units"))


QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
QUERIES |= {"p1_found": p1_found, "p1_measured": p1_measured}
SQL: dict[str, str] = {name: q for part in PARTS for name, q in part.SQL.items()}
