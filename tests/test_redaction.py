"""Redaction rules, one by one and composed, and a brute-force model of the chain."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from callgauge.functions import redaction
from callgauge.functions.plugins import span_finder

KEYS = [
    "sk-" + "a1B2" * 6,
    "sk-ant-" + "a1B2" * 6,
    "AKIA" + "ABCD1234" * 2,
    "gsk_" + "a1B2" * 6,
]
CASES = [
    ("Contact me at john.doe@example.test for details.", ["[EMAIL]"], ["john.doe"]),
    ("Call 555-555-0100 anytime.", ["[PHONE]"], ["555-555-0100"]),
    ("Call +44 20 7946 0958 or +1 (415) 555-0100.", ["[PHONE]"], ["555-0100"]),
    ("SSN: 123-45-6789", ["[SSN]"], ["123-45-6789"]),
    ("Card on file: 4111 1111 1111 1111", ["[CREDIT_CARD]"], ["4111"]),
    ("Tracking number: 1234567890123456", ["[PHONE]6"], ["[CREDIT_CARD]"]),
    ("Connection from 192.168.1.42 rejected.", ["[IP]"], ["192.168.1.42"]),
    (
        "Address 2001:0db8:85a3:0000:0000:8a2e:0370:7334 attempted login.",
        ["[IP]"],
        ["2001:0db8"],
    ),
    *[(f"key {k} here", ["[API_KEY]"], [k]) for k in KEYS],
    ("a" * 1000 + " contact me at safe@example.test", ["aaa"], ["[EMAIL]", "safe@"]),
    ("Tested with openai gpt-4o and anthropic claude-3-5-sonnet.", ["gpt-4o", "sonnet"], ["["]),
    (
        f"mail a@b.co from 10.0.0.1, call 555-555-0100, pay 4111-1111-1111-1111, use {KEYS[0]}",
        ["[EMAIL]", "[IP]", "[PHONE]", "[CREDIT_CARD]", "[API_KEY]"],
        ["a@b.co", "10.0.0.1", "0100", "4111", KEYS[0]],
    ),
    ("", [""], ["["]),
    # digits outside ASCII count as digits
    ("رقم ٤١١١١١١١١١١١١١١١", ["[CREDIT_CARD]"], ["٤١١١"]),
]


@pytest.fixture(scope="module")
def redacted(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    return {r.i: r.out for r in df.select("i", redaction.redact(F.col("text")).alias("out")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(redacted, i):
    _, present, absent = CASES[i]
    assert all(p in redacted[i] for p in present)
    assert not any(a in redacted[i] for a in absent)
    assert len(redacted[i]) <= 507


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(redaction.redact(F.col("text"))).first()[0] is None


def _luhn(match: str) -> bool:
    digits = [int(c) for c in match if c.isdecimal()]
    if not 13 <= len(digits) <= 19:
        return False
    folded = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(folded) % 10 == 0


def _model(text: str) -> str:
    for name, pattern, placeholder in redaction.RULES:
        def put(m, name=name, placeholder=placeholder):
            return m.group() if name == "CREDIT_CARD" and not _luhn(m.group()) else placeholder

        text = re.sub(pattern, put, text)
    return text


def test_chain_equals_a_model_on_generated_texts(spark):
    rng = random.Random(11)
    parts = [
        "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "12 4111111111111111",
        "a.b+c@d-e.io", "x@y", "123-45-6789", "é123-45-6789", "192.168.100.200", "10.1.2.3",
        "fe80:1:2:3:4:5:6:7", "+1 (415) 555-0100", "1700000000", "555 555 0100", "٥٥٥-٥٥٥-٠١٠٠",
        "sk-" + "Z9" * 12, "xoxb-" + "1-" * 12, "word", "naïve", "---", "3.14", "::", "\n", "[EMAIL]",
    ]
    texts = [
        "".join(rng.choice(parts) + rng.choice([" ", "", ", ", "\t", "-"]) for _ in range(rng.randint(1, 12)))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    whole = df.select("i", redaction.redact(F.col("text"), None).alias("out")).collect()
    wrong = [(texts[r.i], r.out, _model(texts[r.i])) for r in whole if r.out != _model(texts[r.i])]
    assert wrong == []


def test_spans(spark):
    df = spark.createDataFrame(
        [
            ("Jane sent the report.", [(0, 4, "PERSON")]),
            ("Jane met Bob in Rome", [(16, 20, "LOCATION"), (0, 4, "PERSON"), (9, 12, "PERSON")]),
            ("nothing here", []),
            ("nothing here", None),
        ],
        "text string, spans array<struct<start:int,end:int,type:string>>",
    )
    got = [r[0] for r in df.select(redaction.replace_spans(F.col("text"), F.col("spans"))).collect()]
    assert got == [
        "[PERSON] sent the report.",
        "[PERSON] met [PERSON] in [LOCATION]",
        "nothing here",
        "nothing here",
    ]


def test_tokens_and_secrets(spark):
    df = spark.createDataFrame([("openai",), ("OpenAI",), ("anthropic",), ("a@b.co",)], "t string")
    assert [r[0] for r in df.select(redaction.is_allowed_token(F.col("t"))).collect()] == [
        True, True, True, False,
    ]
    df = spark.createDataFrame([("abcdefghijkl",), ("",), ("abc",)], "s string")
    shown = df.select(
        redaction.mask_secret(F.col("s")), redaction.mask_secret(F.col("s"), hide_short=True)
    ).collect()
    assert [tuple(r) for r in shown] == [("abcd…ijkl", "abcd…ijkl"), ("", ""), ("abc…abc", "…")]


def test_analyzer_plugin(spark):
    """An analyzer is loaded per task; kinds outside the four are ignored."""

    def load():
        names = (("PERSON", "Jane|Bob"), ("MISC", "met"))
        return lambda t: [(m.start(), m.end(), k) for k, p in names for m in re.finditer(p, t)]

    df = spark.createDataFrame([("Jane met Bob",), ("nobody",), (None,)], "text string")
    find = span_finder(load)
    rows = df.select(redaction.replace_spans(F.col("text"), find("text"))).collect()
    assert [r[0] for r in rows] == ["[PERSON] met [PERSON]", "nobody", None]


def test_span_table(spark):
    df = spark.createDataFrame([(1, "Jane met Bob"), (2, "nobody")], "id int, text string")
    spans = spark.createDataFrame(
        [(1, 9, 12, "PERSON"), (1, 0, 4, "PERSON"), (1, 5, 8, "MISC")],
        "id int, start int, end int, type string",
    )
    rows = redaction.redact_entities(df, "id", "text", spans).collect()
    assert {r.id: r.text for r in rows} == {1: "[PERSON] met [PERSON]", 2: "nobody"}
