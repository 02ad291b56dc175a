"""Binding of a value to a variable inside of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column that a lambda looks at is, once projections are merged, computed for each element that the lambda
    sees. The variable of a transform over one element is computed once and merging can't undo it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
