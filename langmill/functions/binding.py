"""Evaluate-once binding inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Lambda bodies of array functions are outside common-subexpression elimination: an expression
    named there is computed for every element, which turns linear work into quadratic work.
    """
    return F.transform(F.array(value), body)[0]
