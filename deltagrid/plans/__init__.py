"""Registered queries of the geospatial operators and the SQL they are checked against."""

from importlib import import_module

FLAGSHIP = "slice_fixes_by_cell"
MODULES = ("cells", "rules", "tables", "layers", "kinds", "shapes", "joins", "routes", "trips", "letters", "stores", "captures")
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _m = import_module(f".{_name}", __name__)
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
