"""Values that are computed once within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used: bound as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
