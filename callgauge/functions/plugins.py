"""Plug-in points for models that only exist in Python.

Both take a *loader*, a function that is called once per task in the executor and
returns the function to apply to each text. Texts travel as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from callgauge.functions.redaction import ENTITY_TYPES
from callgauge.schema import MAX_LOAD_ATTEMPTS

SPANS = "array<struct<start:int,end:int,type:string>>"
GUARDED = f"struct<spans:{SPANS},error:string>"


def span_finder(load: Callable[[], Callable[[str], Iterable[tuple[int, int, str]]]]):
    """A Column function that returns the entity spans an analyzer finds in a text.

    The analyzer yields (start, end, type); only persons, locations, organizations and
    dates of birth are kept. Feed the result to ``redaction.replace_spans``.
    """
    kinds = frozenset(ENTITY_TYPES)

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyze = load()
        for texts in batches:
            yield texts.map(
                lambda t: []
                if t is None
                else [
                    {"start": start, "end": end, "type": kind}
                    for start, end, kind in analyze(t)
                    if kind in kinds
                ]
            )

    return find


def guarded_span_finder(
    load: Callable[[], Callable[[str], Iterable[tuple[int, int, str]]]],
    attempts: int = MAX_LOAD_ATTEMPTS,
):
    """As ``span_finder``, but a text on which the analyzer fails does not fail the task.

    Returns ``struct(spans, error)``: after ``attempts`` failures on one text its spans are
    NULL and ``error`` names the exception (without its message, which may quote the text).
    A loader that fails is no matter of single texts and still fails the task.
    """
    kinds = frozenset(ENTITY_TYPES)

    @F.pandas_udf(GUARDED)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        analyze = load()

        def spans_of(text: str | None) -> tuple[list | None, str | None]:
            if text is None:
                return [], None
            for left in reversed(range(attempts)):
                try:
                    found = [
                        {"start": start, "end": end, "type": kind}
                        for start, end, kind in analyze(text)
                        if kind in kinds
                    ]
                    return found, None
                except Exception as error:
                    if not left:
                        return None, type(error).__name__

        for texts in batches:
            yield pd.DataFrame(map(spans_of, texts), columns=["spans", "error"], dtype=object)

    return find


def token_counter(load: Callable[[], Callable[[str], int]]):
    """A Column function that counts the tokens of a text with a real tokenizer.

    Use it as the ``estimator`` of ``assembly.backfill_usage`` or ``records.build``.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = load()
        for texts in batches:
            yield texts.map(lambda t: 0 if not t else tokens(t)).astype("int32")

    return count
