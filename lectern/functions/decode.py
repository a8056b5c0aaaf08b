"""Reading JSON that may be wrapped in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvage_json(body: Column) -> Column:
    """The JSON text inside a body: as is, else first ``{`` to last ``}``; else NULL."""
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body).when(
        (inner != "") & F.try_parse_json(inner).isNotNull(), inner
    )
