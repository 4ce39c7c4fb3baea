"""The timeline queries and the SQL that gives the same rows."""

from . import events, folds, joins, projections, reports, runs, tracking, windows

_MODULES = (windows, joins, folds, reports, projections, events, tracking, runs)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
