"""Registered queries over the run grid, each with its SQL twin."""

from . import dynamics, geometry, ingest, selection, streams  # noqa: F401
from .grid import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
