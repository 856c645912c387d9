"""Admission of telemetry records and chat input.

A record is checked against every rule in one pass. The result carries the typed
record and the list of broken rules; an empty list means the record is good. Rule
names read ``<field>:<what is wrong>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.instants import instant_sql
from callgauge.functions.text import strip
from callgauge.schema import (
    MESSAGE_CHARS,
    MESSAGE_ROLES,
    RECORD_FIELDS,
    TITLE_CHARS,
    USERNAME_CHARS,
    UUID_PATTERN,
    Field,
)

INT_MAX = 2**31 - 1
NUMERIC = "'^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"


def _parsed_as(field: Field) -> str:
    """The type a field is parsed as.

    A required number of the wrong JSON type becomes NULL and is refused as such. Ids,
    names from a fixed list and instants are refused by their pattern. Free text, and
    scalars that may be left out, are kept as VARIANT, so that their JSON type can be
    asked for and an explicit null differs from an absent field.
    """
    if field.kind == "object":
        return "map<string,variant>"
    if not field.required or (field.kind == "text" and not field.choices):
        return "variant"
    return "double" if field.kind in ("number", "integer") else "string"


DOCUMENT = ",".join(f"`{f.name}`:{_parsed_as(f)}" for f in RECORD_FIELDS)
VARIANTS = [f for f in RECORD_FIELDS if _parsed_as(f) == "variant"]


def _value_sql(field: Field) -> str:
    """The value in its stored type, or NULL when the JSON type does not fit."""
    value, kind = f"_doc.`{field.name}`", f"_kind_{field.name}"
    if field.kind == "object":
        return f"to_json({value})"
    if field.kind == "instant":
        return f"upper({value})"
    if field not in VARIANTS:
        return value
    if field.kind in ("text", "uuid"):
        return f"CASE WHEN {kind} = 'STRING' THEN try_variant_get({value}, '$', 'string') END"
    return f"CASE WHEN {kind} RLIKE {NUMERIC} THEN try_variant_get({value}, '$', 'double') END"


def _rules(field: Field) -> dict[str, str]:
    """Rule name -> SQL condition under which the field breaks it."""
    name, value = field.name, f"_v_{field.name}"
    rules = {}
    if field.required:
        rules["type"] = f"{value} IS NULL AND array_contains(_keys, '{name}')"
    elif field in VARIANTS:
        rules["type"] = f"{value} IS NULL AND _kind_{name} <> 'VOID'"
    elif field.kind == "object":
        # it may be left out, but an explicit null is not an object
        rules["type"] = f"{value} IS NULL AND array_contains(_keys, '{name}')"
    if field.kind == "uuid":
        rules["uuid"] = f"NOT {value} RLIKE '{UUID_PATTERN}'"
    if field.kind == "instant":
        rules["instant"] = f"{value} IS NOT NULL AND _at_{name} IS NULL"
    if field.kind == "number":
        rules["range"] = f"{value} < 0 OR isnan({value})"
    if field.kind == "integer":
        rules["range"] = f"{value} < 0 OR {value} > {INT_MAX}"
        rules["fraction"] = f"{value} <> floor({value})"
    if field.choices:
        rules["choice"] = f"{value} NOT IN ({', '.join(repr(c) for c in field.choices)})"
    if field.max_chars is not None:
        rules["length"] = f"length({value}) NOT BETWEEN {field.min_chars or 0} AND {field.max_chars}"
    return rules


def _record_sql(field: Field) -> str:
    value = f"_v_{field.name}"
    if field.kind == "integer":
        value = f"CAST(CASE WHEN {value} <= {INT_MAX} THEN {value} END AS INT)"
    elif field.kind == "instant":
        value = f"_at_{field.name}"
    elif field.kind == "object":
        value = f"coalesce({value}, '{{}}')"
    return f"'{field.name}', {value}"


def check(feed: DataFrame) -> DataFrame:
    """Feed rows plus ``record`` (typed) and ``errors``.

    The payload is parsed once, into the record's own schema; its keys are listed to
    tell unknown and absent ones. Wrapping it in brackets makes the parser see the end
    of the text, so trailing garbage is refused too.
    """
    kept = [f"`{c}`" for c in feed.columns]
    instants = [f for f in RECORD_FIELDS if f.kind == "instant"]
    values = [f"{_value_sql(f)} AS _v_{f.name}" for f in RECORD_FIELDS]
    names = ", ".join(f"'{f.name}'" for f in RECORD_FIELDS)
    required = [f.name for f in RECORD_FIELDS if f.required]
    required_names = ", ".join(f"'{name}'" for name in required)
    lacking = " OR ".join(f"_v_{name} IS NULL" for name in required)
    # every known value that is not NULL has a key of its own; with as many keys as
    # such values there is no other key, and the key lists need not be compared
    present = " + ".join(f"CAST(_doc.`{f.name}` IS NOT NULL AS INT)" for f in RECORD_FIELDS)
    broken = [
        f"CASE WHEN size(_keys) <> _present AND size(array_except(_keys, array({names}))) > 0"
        " THEN 'record:unknown_key' END",
        f"CASE WHEN {lacking} THEN transform(array_except(array({required_names}), _keys),"
        " f -> f || ':missing') END",
    ]
    broken += [
        f"CASE WHEN {condition} THEN '{f.name}:{rule}' END"
        for f in RECORD_FIELDS
        for rule, condition in _rules(f).items()
    ]
    record = f"named_struct({', '.join(_record_sql(f) for f in RECORD_FIELDS)})"
    # concat_ws skips the NULLs of unbroken rules
    reasons = (
        "CASE WHEN _malformed THEN 'payload:malformed' "
        f"ELSE concat_ws(',', {', '.join(broken)}) END"
    )
    errors = "CASE WHEN _reasons = '' THEN CAST(array() AS array<string>) ELSE split(_reasons, ',') END"
    return (
        feed.selectExpr(
            *kept, f"from_json('[' || payload || ']', 'array<struct<{DOCUMENT}>>') AS _docs"
        )
        .selectExpr(
            *kept,
            "CASE WHEN size(_docs) = 1 THEN get(_docs, 0) END AS _doc",
            "CASE WHEN size(_docs) = 1 THEN json_object_keys(payload) END AS _keys",
        )
        .selectExpr("*", *[f"schema_of_variant(_doc.`{f.name}`) AS _kind_{f.name}" for f in VARIANTS])
        .selectExpr("*", "_doc IS NULL AS _malformed", f"{present} AS _present", *values)
        .drop("_doc")
        .selectExpr("*", *[f"{instant_sql(f'_v_{f.name}')} AS _at_{f.name}" for f in instants])
        .selectExpr("*", f"{reasons} AS _reasons")
        # a one-row generator: filters on ``errors`` stay above it, so the payload is
        # not parsed again inside the filter
        .selectExpr(*kept, f"inline(array(named_struct('record', {record}, 'errors', {errors})))")
    )


def good(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def dead(checked: DataFrame) -> DataFrame:
    """Dead letters: the original feed fields plus the reasons."""
    return checked.where(F.size("errors") > 0).drop("record")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead). Persist ``checked`` first when both sides are written."""
    return good(checked), dead(checked)


def counts(checked: DataFrame) -> DataFrame:
    """One row: how many rows are good and how many are dead."""
    return checked.agg(
        F.count_if(F.size("errors") == 0).alias("n_good"),
        F.count_if(F.size("errors") > 0).alias("n_dead"),
    )


def _with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = [F.when(F.coalesce(broken, F.lit(True)), F.lit(n)) for n, broken in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*found)))


def check_messages(messages: DataFrame) -> DataFrame:
    """Role must be known and content at most 200 000 characters."""
    return _with_errors(
        messages,
        {
            "role:choice": ~F.col("role").isin(*MESSAGE_ROLES),
            "content:length": F.length("content") > MESSAGE_CHARS,
        },
    )


def check_users(users: DataFrame) -> DataFrame:
    """Names have 1 to 64 characters and are not blank."""
    return _with_errors(
        users,
        {
            "username:length": ~F.length("username").between(1, USERNAME_CHARS),
            "username:blank": strip(F.col("username")) == "",
        },
    )


def check_sessions(sessions: DataFrame) -> DataFrame:
    """A title is optional and has at most 255 characters."""
    return _with_errors(
        sessions,
        {"title:length": F.coalesce(F.length("title") > TITLE_CHARS, F.lit(False))},
    )


def admitted(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose (provider, model) is registered."""
    return requests.join(registry, ["provider", "model"], "left_semi")


def refused(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose (provider, model) is not registered."""
    return requests.join(registry, ["provider", "model"], "left_anti")
