"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgauge.schema import PREVIEW_CHARS


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """The first ``chars`` characters; NULL stays NULL."""
    return F.substring(text, 1, chars)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    """NULL for an empty text."""
    return F.when(text != "", text)


def estimated_tokens(text: Column) -> Column:
    """Default token estimate: four characters per token, rounded up, 0 for no text.

    Operators take any ``Column -> Column`` in its place, e.g. a ``pandas_udf``
    around a tokenizer.
    """
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("int")
