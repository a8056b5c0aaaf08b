"""The registered queries: fixtures derived from the given tables, Spark queries
over the library operators, and the SQL each result is checked against."""


def all_queries():
    """(queries, oracles), importing every family."""
    from . import (  # noqa: F401
        q_library, q_notes, q_packing, q_quality, q_requests, q_rounds, q_scalars, q_screen,
        q_sources, q_streams,
    )
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
