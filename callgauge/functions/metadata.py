"""JSON object columns: merging and flags.

Values are carried as VARIANT, so numbers, booleans, nested objects and JSON nulls
keep their type; a plain string map would quote them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def as_object(json_text: Column) -> Column:
    """The members of a JSON object; an empty map for NULL or anything else."""
    return F.coalesce(F.from_json(json_text, OBJECT), F.expr(f"CAST(map() AS {OBJECT})"))


def merge_objects(*objects: Column) -> Column:
    """Merge JSON objects given as text; the last writer of a key wins."""
    merged = as_object(objects[0])
    for later in objects[1:]:
        merged = _overlay(merged, as_object(later))
    return F.to_json(merged)


def _overlay(base: Column, extra: Column) -> Column:
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def flag_if(json_text: Column, name: str, condition: Column) -> Column:
    """Set ``name`` to true where ``condition`` holds; other rows stay untouched."""
    return F.when(condition, merge_objects(json_text, F.lit(f'{{"{name}":true}}'))).otherwise(
        F.coalesce(json_text, F.lit("{}"))
    )


def member(json_text: Column, name: str) -> Column:
    """One member as text."""
    return F.get_json_object(json_text, f"$.{name}")
