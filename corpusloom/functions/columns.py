"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once.

    A column used inside a lambda may be computed anew for every element; a lambda over
    an array of one binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
