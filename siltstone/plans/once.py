"""Keeping expensive columns from being computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """df behind a generator of one row.

    Catalyst pushes filters below projections by putting the projected
    expressions into them, and would evaluate a long CASE for the filter and
    again for the column, with all that they are made of.  It doesn't push
    through a generator's output; a generator of one row costs next to nothing
    and keeps whole-stage code generation.
    """
    return df.select(F.inline(F.array(F.struct(*(df[c] for c in df.columns)))))
