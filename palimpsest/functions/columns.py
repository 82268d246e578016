"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, evaluated once a row; a column named inside a lambda may be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
