"""Registered queries and their SQL, by area."""

from . import aggregates, files, functions, joins, plans, quality, windows

AREAS = (windows, joins, aggregates, functions, quality, plans, files)


def queries():
    return {name: q[0] for area in AREAS for name, q in area.QUERIES.items()}


def oracle_sql():
    return {name: q[1] for area in AREAS for name, q in area.QUERIES.items() if q[1]}
