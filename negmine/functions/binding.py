"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    Without the binding every use copies the expression, and copies of copies
    grow until planning takes longer than the work.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
