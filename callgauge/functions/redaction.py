"""Removal of personal data and secrets from text, as Column expressions.

The rules run in a fixed order and each one sees the text the previous one left.
That order is visible in results: a card-like number that fails its checksum is
still open to the phone rule, and an address whose tail looks like a phone number
is taken by the phone rule before the address rule runs.

Everything is evaluated by Spark's own regular expressions; no Python runs in the
executors.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.expressions import bind
from callgauge.schema import ALLOWED_TOKENS, PREVIEW_CHARS

# --- fixed values: (rule, pattern, placeholder) in the order they are applied ---
RULES = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (
        "API_KEY",
        r"\b(sk-[A-Za-z0-9_-]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}"
        r"|gsk_[A-Za-z0-9]{20,}|xoxb-[A-Za-z0-9-]{20,})\b",
        "[API_KEY]",
    ),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b", "[CREDIT_CARD]"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (
        "PHONE",
        r"(?:\+?\d{1,3}[-.\s]?)?(?:\(\d{2,4}\)|\d{2,4})[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
        "[PHONE]",
    ),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "[IP]"),
)
KEY_PREFIXES = ("sk-", "AKIA", "gsk_", "xoxb-")
CARD_DIGITS = (13, 19)
ENTITY_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "DATE_OF_BIRTH")
# --- end of fixed values ---------------------------------------------------------

CARD_RULE = "CREDIT_CARD"


def _unicode(pattern: str) -> str:
    # \b, \d and \s cover all of Unicode, not only ASCII
    return "(?U)" + pattern


def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit, and the ASCII digit it stands for."""
    wide = [
        chr(code)
        for code in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(code)) == "Nd"
    ]
    return "".join(wide), "".join(str(unicodedata.decimal(c)) for c in wide)


_WIDE_DIGITS, _PLAIN_DIGITS = _decimal_digits()


def passes_luhn(number: Column) -> Column:
    """Checksum test of a number written with optional spaces and dashes."""
    digits = F.translate(
        F.regexp_replace(number, "[ -]", ""), _WIDE_DIGITS, _PLAIN_DIGITS
    )

    def checksum(d: Column) -> Column:
        size = F.length(d)

        def weigh(place: Column) -> Column:
            # places count from the right, starting at 1; even ones are doubled
            digit = F.substring(d, size + 1 - place, F.lit(1)).cast("int")
            doubled = digit * 2
            folded = F.when(doubled > 9, doubled - 9).otherwise(doubled)
            return F.when(place % 2 == 0, folded).otherwise(digit)

        total = F.aggregate(
            F.transform(F.sequence(F.lit(1), size), weigh),
            F.lit(0),
            lambda acc, x: acc + x,
        )
        return F.when(size.between(*CARD_DIGITS), total % 10 == 0).otherwise(F.lit(False))

    return F.coalesce(bind(digits, checksum), F.lit(False))


def _replace_cards(text: Column, pattern: str, placeholder: str) -> Column:
    """Replace only the matches that pass the checksum; keep the others as they are."""

    def rebuild(t: Column) -> Column:
        matches = F.transform(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda m: F.when(passes_luhn(m), F.lit(placeholder)).otherwise(m),
        )
        return bind(
            matches,
            lambda found: F.array_join(
                F.transform(
                    F.split(t, pattern, -1),
                    lambda piece, i: F.concat(piece, F.coalesce(F.get(found, i), F.lit(""))),
                ),
                "",
            ),
        )

    # texts without a card-like number skip the rebuilding altogether
    return bind(text, lambda t: F.when(t.rlike(pattern), rebuild(t)).otherwise(t))


def _needs(name: str) -> str:
    """What every match of a rule contains; most texts lack it and skip the rule."""
    return {"EMAIL": "an at sign", "API_KEY": "a key prefix", "IPV6": "a colon"}.get(name, "a digit")


def _may_match(text: Column, need: str) -> Column:
    if need == "an at sign":
        return text.contains("@")
    if need == "a colon":
        return text.contains(":")
    if need == "a key prefix":
        return reduce(or_, [text.contains(p) for p in KEY_PREFIXES])
    return text.rlike(_unicode(r"\d"))


def _replaced(text: Column, name: str) -> Column:
    pattern, placeholder = next((_unicode(p), ph) for rule, p, ph in RULES if rule == name)
    if name == CARD_RULE:
        return _replace_cards(text, pattern, placeholder)
    return F.regexp_replace(text, pattern, placeholder)


def _guarded(text: Column, need: str, names: Sequence[str]) -> Column:
    return bind(
        text,
        lambda t: F.when(_may_match(t, need), reduce(_replaced, names, t)).otherwise(t),
    )


def apply_rules(text: Column, names: Sequence[str]) -> Column:
    """Apply rules in the given order; neighbours with the same need share its test."""
    for need, group in groupby(names, key=_needs):
        text = _guarded(text, need, list(group))
    return text


def count_rule(text: Column, name: str) -> Column:
    """How often one rule would replace something in the text."""
    pattern = next(_unicode(p) for rule, p, _ in RULES if rule == name)
    if name == CARD_RULE:
        hits = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), passes_luhn)
        found = F.size(hits)
    else:
        found = F.regexp_count(text, F.lit(pattern))
    return F.when(_may_match(text, _needs(name)), found).otherwise(F.lit(0))


def redact(text: Column, max_chars: int | None = PREVIEW_CHARS) -> Column:
    """All rules in order. NULL stays NULL.

    Previews are cut to ``max_chars`` first, so text behind the cut is dropped and
    not redacted. ``max_chars=None`` redacts the whole text.
    """
    current = text if max_chars is None else F.substring(text, 1, max_chars)
    return apply_rules(current, [name for name, _, _ in RULES])


def replace_spans(text: Column, spans: Column) -> Column:
    """Replace entity spans ``array<struct<start,end,type>>`` by ``[TYPE]``.

    Offsets count code points from 0, ends are exclusive. Spans are applied from
    the right so earlier offsets stay valid; no spans leave the text unchanged.
    """
    ordered = F.reverse(F.array_sort(spans))
    replaced = F.aggregate(
        ordered,
        text,
        lambda acc, s: F.concat(
            F.substring(acc, F.lit(1), s["start"]),
            F.lit("["),
            s["type"],
            F.lit("]"),
            F.substring(acc, s["end"] + 1, F.length(acc)),
        ),
    )
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, replaced).otherwise(text)


def redact_entities(df: DataFrame, key: str, column: str, spans: DataFrame) -> DataFrame:
    """Apply a table of entity spans (key, start, end, type) to a text column.

    The spans of one text are gathered into its row; texts without spans stay as they
    are.
    """
    known = spans.where(F.col("type").isin(*ENTITY_TYPES))
    found = known.groupBy(key).agg(F.collect_list(F.struct("start", "end", "type")).alias("_spans"))
    replaced = replace_spans(F.col(column), F.col("_spans"))
    return df.join(found, key, "left").withColumn(column, replaced).select(*df.columns)


def report(df: DataFrame, column: str, max_chars: int | None = None) -> DataFrame:
    """Per rule: rows with a hit and number of replacements, on the running text.

    One pass over the data; each task folds its rows into seven counters before
    anything is exchanged. A rule replaces only where it was counted.
    """
    text = F.col(column) if max_chars is None else F.substring(column, 1, max_chars)
    running = df.select(F.coalesce(text, F.lit("")).alias("text"))
    for name, _, _ in RULES:
        kept = [F.col(c) for c in running.columns if c != "text"]
        found, counted = F.col(f"n_{name}"), count_rule(F.col("text"), name).cast("bigint")
        running = running.select(*kept, counted.alias(f"n_{name}"), "text").select(
            *kept,
            found,
            F.when(found > 0, _replaced(F.col("text"), name)).otherwise(F.col("text")).alias("text"),
        )
    totals = running.agg(
        *[
            F.struct(
                F.count_if(F.col(f"n_{name}") > 0).alias("rows_hit"),
                F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias("replacements"),
            ).alias(name)
            for name, _, _ in RULES
        ]
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(step).alias("step"),
                        F.lit(name).alias("rule"),
                        F.col(name)["rows_hit"].alias("rows_hit"),
                        F.col(name)["replacements"].alias("replacements"),
                    )
                    for step, (name, _, _) in enumerate(RULES, start=1)
                ]
            )
        )
    )


def is_allowed_token(token: Column) -> Column:
    """True for provider and model family names, whatever their case."""
    return F.lower(token).isin(*ALLOWED_TOKENS)


def mask_secret(secret: Column, hide_short: bool = False) -> Column:
    """First four and last four characters; an empty secret stays empty.

    Secrets shorter than eight characters would be shown whole; ``hide_short``
    masks those completely.
    """
    s = F.coalesce(secret, F.lit(""))
    shown = F.concat(F.left(s, F.lit(4)), F.lit("…"), F.right(s, F.lit(4)))
    if hide_short:
        shown = F.when(F.length(s) < 8, F.lit("…")).otherwise(shown)
    return F.when(s == "", F.lit("")).otherwise(shown)
