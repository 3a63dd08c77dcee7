"""Every query of the grounded-knowledge operators by name, with its SQL."""

from __future__ import annotations

from .plans import knowledge, structure, surface

FLAGSHIP = "scope_query"
QUERIES = structure.QUERIES | knowledge.QUERIES | surface.QUERIES
SQL = structure.SQL | knowledge.SQL | surface.SQL
