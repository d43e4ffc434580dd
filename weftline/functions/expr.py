"""Building blocks for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A Python helper that names its argument k times repeats the whole expression k times,
    and a chain of such helpers grows exponentially.  Bound like this, it grows linearly.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Each step's result bound for the next one."""
    for step in steps:
        value = let(value, step)
    return value
