"""Money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def money_text(c: Column) -> Column:
    """``NT$ 1,234``; halves round up, as amounts are shown to people."""
    whole = F.floor(or_zero(c) + F.lit(0.5).cast("decimal(2,1)"))
    return F.concat(F.lit("NT$ "), F.format_number(whole, 0))


def exact_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(20,2)")
