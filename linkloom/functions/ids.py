"""Comparison form of identifiers that people and programs wrote by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_form(column: Column | str) -> Column:
    """Blanks and tabs cut at both ends, lower case; null for a null or then empty id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(" \t"))), F.lit(""))
