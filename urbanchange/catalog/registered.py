"""All registered queries and their SQL."""

from __future__ import annotations

from urbanchange.catalog import change, geometry, model, raster, score
from urbanchange.catalog.fixtures import FX, with_clause

_MODULES = (raster, geometry, change, score, model)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
_STATEMENTS = dict(FX)
for _module in _MODULES:
    _STATEMENTS.update(_module.STATEMENTS)
ORACLES = {
    name: with_clause(text, _STATEMENTS, recursive=True)
    for module in _MODULES
    for name, text in module.ORACLE.items()
}
