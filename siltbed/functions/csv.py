"""RFC 4180 fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_field(value: Column) -> Column:
    """``value``, quoted if it holds a comma, a quote or a line end, with inner quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(value)
