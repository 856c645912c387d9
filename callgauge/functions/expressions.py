"""Small building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Column expressions are trees, so using an expensive expression twice computes
    it twice; passing it through a one-element array gives it a name.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
