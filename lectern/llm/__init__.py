"""Operators of a training-data pipeline, and their registered queries.

Nothing outside this folder imports it. ``all_queries`` gives the driver the queries
of ``queries.py`` and the pipeline, with the SQL they are checked against.
"""


def all_queries():
    """(queries, oracles) of this package."""
    from . import queries

    return queries.QUERIES, queries.ORACLES
