"""Values bound once inside column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used: expressions that use others several
    times, one inside another, would grow with every level."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(c: Column) -> Column:
    """A text of digits as a number, null if it is empty: a cast that fails costs an exception in every row, which takes
    longer than all else that is done with a name."""
    return F.nullif(c, F.lit("")).try_cast("int")


def once(function: Callable[..., Column]) -> Callable[..., Column]:
    """A function of a column that takes its first argument by `let`."""

    @functools.wraps(function)
    def bound(value: Column, *others, **named) -> Column:  # noqa: ANN002, ANN003
        return let(value, lambda x: function(x, *others, **named))

    return bound
