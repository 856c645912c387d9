"""Secret scans: three base patterns, and a lexer that follows assignments.

The lexer reads whatever looks like source or configuration in a text: names, string
literals, bare configuration values, assignment signs and ``+``. A literal (or a
concatenation) assigned to a name becomes a constant; a name on the right-hand side stands
for the constant it holds. Every literal that reaches a target is scored by how sensitive
the target's name is and how much the value looks like a secret; high scores are added to
the spans of the base patterns as kind ``literal``. What follows a comment sign (``#`` or
``//``) up to the end of its line is lexed likewise, as a run of its own with constants of
its own, and its literals get the kind ``comment``.

Work and memory grow with the text, whatever it says: a value is a tree over the literals it
is made of, shared between the constants that hold it, and is scored by counts of its
characters, never spelled out. So is every place added once, however often its value is used.

Defined results: a null or empty text has no spans. Offsets count code points, ends are
exclusive. Texts are read whole; the lexer only starts on texts that hold a sensitive word
at all, since without one no target can score.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

KINDS = ("assign", "access", "hex", "literal", "comment")
THRESHOLD = 0.5
MASK = "[SECRET]"

_WORDS = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(
    rf"(?ai:({_WORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# matches of AKIA[A-Z0-9]+ and [0-9a-f]+ that are long enough; a maximal run has one match
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# fixed values: how much a part of a target's name tells
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "api_key": 1.0,
    "access_key": 1.0,
    "private_key": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.7,
    "bearer": 0.8,
}
# fixed values: parts that say the value is not the secret itself
HARMLESS = ("name", "path", "file", "url", "length", "len", "count", "type", "expiry", "ttl")
_HINT = re.compile(r"(?ai)pass(?:word|wd|phrase)|pwd|secret|token|key|credential|auth|bearer")
_PLACEHOLDER = re.compile(
    r"(?ai)^(?:changeme|example|placeholder|none|null|true|false|undefined"
    r"|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$"
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int


_COMMENT = r"(?P<comment>(?<![^\s;{}])(?P<sign>\#|//)[^\n]*)"
_PARTS = r"""
      (?P<string>(?<!\w)(?:"(?!"")[^"\\\n]*"|'(?!'')[^'\\\n]*'))  # the plain ones
    | (?P<quote>(?<!\w)["'`])
    | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
    | (?P<op>==|!=|<=|>=|=>|:=|\+=|[=:+])
    | (?P<end>[\n;,(){}])
    | (?P<index>[\[\]])
    | (?P<other>[^\s])
    """
_FLAGS = re.VERBOSE | re.DOTALL | re.ASCII
_TOKEN = re.compile(f"{_COMMENT} | {_PARTS}", _FLAGS)
_COMMENTED = re.compile(_PARTS, _FLAGS)
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]]+")
_ASSIGNING = ("=", ":", ":=", "=>", "+=")
# from a quote to its end, or to where an unclosed string is given up (the group is empty)
_STRINGS = {
    '"""': re.compile(r'(?s)"""(?:[^\\]|\\.)*?("""|\Z)'),
    "'''": re.compile(r"(?s)'''(?:[^\\]|\\.)*?('''|\Z)"),
    '"': re.compile(r'(?s)"(?:[^"\\\n]|\\.)*+("?)'),
    "'": re.compile(r"(?s)'(?:[^'\\\n]|\\.)*+('?)"),
    "`": re.compile(r"(?s)`(?:[^`\\]|\\.)*+(`?)"),
}
_TOKEN_KINDS = ("string", "name", "op", "end", "index", "other")
_CODES = {kind: code for code, kind in enumerate(_TOKEN_KINDS)}
_VALUES = (_CODES["name"], _CODES["string"])


def _inner(text: str, start: int, end: int) -> tuple[int, int]:
    width = 3 if text[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
    return start + width, end - width


def name_score(name: str) -> float:
    """How sensitive a target's name is, from the words in it."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    words = re.split(r"[^a-z0-9]+", parts)
    if words and words[-1] in HARMLESS:
        return 0.0
    pairs = [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)


# --- values -----------------------------------------------------------------------------


class Literal(NamedTuple):
    """A stretch of the text."""

    start: int
    end: int


class Joined:
    """Two values side by side; values may share parts, so they form a graph without cycles."""

    __slots__ = ("left", "right", "told")

    def __init__(self, left: Value, right: Value):
        self.left, self.right = left, right
        self.told = False  # its places were reported


Value = Literal | Joined


class Summary(NamedTuple):
    """What scoring needs of a value, of bounded size."""

    length: float
    counts: dict[int, float]  # characters; beyond Latin-1 they share 256 classes
    spaced: bool
    head: str
    tail: str


_EDGE = 32  # characters kept of either end; more than any fixed placeholder has
_HUGE = 1e200  # from here on only the characters' shares matter
_KEPT = 4096  # summaries at hand
_SPACE = re.compile(r"\s")


def summarised(text: str) -> Summary:
    counts: dict[int, float] = {}
    for char, n in Counter(text).items():
        code = ord(char)
        code = code if code < 256 else 256 + code % 256
        counts[code] = counts.get(code, 0) + n
    spaced = _SPACE.search(text) is not None
    return Summary(len(text), counts, spaced, text[: 2 * _EDGE], text[-_EDGE:])


def _together(a: Summary, b: Summary) -> Summary:
    length, counts = a.length + b.length, dict(a.counts)
    for code, n in b.counts.items():
        counts[code] = counts.get(code, 0) + n
    if length > _HUGE:
        length, counts = length / _HUGE + _EDGE, {c: n / _HUGE for c, n in counts.items()}
    head = a.head + b.head if a.length < 2 * _EDGE else a.head
    tail = a.tail + b.tail if b.length < _EDGE else b.tail
    return Summary(length, counts, a.spaced or b.spaced, head[: 2 * _EDGE], tail[-_EDGE:])


class Summaries:
    """Summaries of the values of one text, each worked out from its parts'."""

    def __init__(self, text: str):
        self.text = text
        self.known: OrderedDict[Value, Summary] = OrderedDict()

    def of(self, value: Value) -> Summary:
        held: dict[Value, Summary] = {}  # of this walk
        waiting = [value]
        while waiting:
            at = waiting[-1]
            found = held.get(at) or self.known.get(at)
            if found is None and isinstance(at, Literal):
                found = summarised(self.text[at.start : at.end])
            if found is None:
                parts = [held.get(p) or self.known.get(p) for p in (at.left, at.right)]
                missing = [p for p, s in zip((at.left, at.right), parts, strict=True) if s is None]
                if missing:
                    waiting += missing
                    continue
                found = _together(*parts)
            held[at] = found
            waiting.pop()
        for at, found in held.items():
            if at is value or (isinstance(at, Literal) and found.length > len(found.head)):
                self.known[at] = found
                self.known.move_to_end(at)
        while len(self.known) > _KEPT:
            self.known.popitem(last=False)
        return held[value]


def value_score(value: str | Summary) -> float:
    """How much a literal looks like a secret: length, no spaces, variety of characters."""
    if isinstance(value, str):
        value = summarised(value)
    n, counts = value.length, value.counts
    if n < 8 or value.spaced or set(counts) <= {120, 88} or set(counts) in ({42}, {46}):
        return 0.0
    # long values are judged by their ends
    if _PLACEHOLDER.match(value.head if n <= 2 * _EDGE else value.head[:_EDGE] + value.tail):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values() if c)
    return min(1.0, 0.25 + bits / 4)


def spelled(text: str, value: Value) -> str:
    """The value written out, which may be far longer than the text."""
    if isinstance(value, Literal):
        return text[value.start : value.end]
    return spelled(text, value.left) + spelled(text, value.right)


def _tell(value: Value, places: set[Literal]) -> None:
    """Add the literals of a value; parts that were added before are not walked again."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, Literal):
            if at.start < at.end:
                places.add(at)
        elif not at.told:
            at.told = True
            waiting += (at.left, at.right)


# --- assignments ------------------------------------------------------------------------


class Tokens:
    """Tokens of a text, in three arrays."""

    def __init__(self, text: str):
        self.text = text
        self.kinds = bytearray()
        self.starts, self.ends = array("q"), array("q")

    def __len__(self) -> int:
        return len(self.kinds)

    def kind(self, i: int) -> str | None:
        return _TOKEN_KINDS[self.kinds[i]] if i < len(self.kinds) else None

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]] if i < len(self.kinds) else ""


def _string_end(text: str, start: int, end: int, unclosed: dict[str, int]) -> int | None:
    """Where the string that starts at a quote ends, None if it doesn't.

    A search that found no end passed every place between where a later string of the same
    quote could end, so up to where it gave up no further search is made.
    """
    quote = text[start]
    for form in (3 * quote, quote):
        if form not in _STRINGS or not text.startswith(form, start) or start < unclosed[form]:
            continue
        m = _STRINGS[form].match(text, start, end)
        if m and m[1]:
            return m.end()
        unclosed[form] = m.end() if m else end
    return None


def lexed(text: str) -> tuple[Tokens, Tokens]:
    """The tokens outside comments, and those inside, without the comment signs."""
    code, comments = Tokens(text), Tokens(text)

    def run(pattern: re.Pattern, tokens: Tokens, at: int, end: int) -> None:
        search, unclosed = pattern.search, dict.fromkeys(_STRINGS, -1)
        kinds, starts, ends = tokens.kinds.append, tokens.starts.append, tokens.ends.append
        while m := search(text, at, end):
            kind = m.lastgroup
            start, at = m.span()
            if kind == "comment":
                run(_COMMENTED, comments, m.end("sign"), at)
                comments.kinds.append(_CODES["end"])
                comments.starts.append(at)
                comments.ends.append(at)
                continue
            if kind == "quote":
                closed = _string_end(text, start, end, unclosed)
                kind, at = ("other", at) if closed is None else ("string", closed)
            kinds(_CODES[kind])
            starts(start)
            ends(at)

    run(_TOKEN, code, 0, len(text))
    return code, comments


def assignments(tokens: Tokens) -> Iterator[tuple[str, Value]]:
    """(target name, value) per assignment."""
    text = tokens.text
    lines = array("q", (m.start() for m in re.finditer("\n", text)))
    constants: dict[str, Value] = {}
    i, kinds = 0, tokens.kinds
    while i < len(kinds):
        if kinds[i] not in _VALUES:
            i += 1
            continue
        j = i + 1
        if tokens.kind(j) == "index" and tokens.word(j) == "]":  # settings["name"] = ...
            j += 1
        sign = tokens.word(j) if tokens.kind(j) == "op" else ""
        target = ""
        if sign in _ASSIGNING:
            a, b = tokens.starts[i], tokens.ends[i]
            a, b = _inner(text, a, b) if tokens.kind(i) == "string" else (a, b)
            target = text[a:b]
        if not target:
            i += 1
            continue
        if (  # a declared type: name: str = ...
            sign == ":"
            and tokens.kind(j + 1) == "name"
            and tokens.kind(j + 2) == "op"
            and tokens.word(j + 2) == "="
        ):
            j += 2
        line = bisect_left(lines, tokens.ends[j])
        value, after = _expression(
            tokens, j + 1, constants, lines[line] if line < len(lines) else len(text)
        )
        if value is None:
            i = j + 1
            continue
        if sign == "+=" and target in constants:
            value = Joined(constants[target], value)
        yield target, value
        constants[target] = value
        i = max(after, j + 1)


def _expression(
    tokens: Tokens, i: int, constants: dict[str, Value], line_end: int
) -> tuple[Value | None, int]:
    """Literals, constants and bare values joined by ``+`` or standing side by side."""
    value: Value | None = None
    while i < len(tokens):
        kind, start = tokens.kind(i), tokens.starts[i]
        if kind == "string":
            part: Value = Literal(*_inner(tokens.text, start, tokens.ends[i]))
        elif kind == "name" and (known := constants.get(tokens.word(i))) is not None:
            part = known
        elif value is None and kind in ("name", "other") and start < line_end:
            bare = _BARE.match(tokens.text, start)
            if bare is None:
                return value, i
            while i < len(tokens) and tokens.starts[i] < bare.end():
                i += 1
            return Literal(start, bare.end()), i
        else:
            return value, i
        value = part if value is None else Joined(value, part)
        i += 1
        if tokens.kind(i) == "op" and tokens.word(i) == "+":
            i += 1
        elif tokens.kind(i) != "string" or tokens.starts[i] > line_end:
            return value, i
    return value, i


def literals(tokens: Tokens) -> set[Literal]:
    """Places of the literals in values that score."""
    summaries, places = Summaries(tokens.text), set()
    for target, value in assignments(tokens):
        named = name_score(target)
        if named and named * value_score(summaries.of(value)) >= THRESHOLD:
            _tell(value, places)
    return places


# --- texts ------------------------------------------------------------------------------


def find(text: str | None) -> list[Span]:
    """All spans of a text, by start, then in the order of KINDS."""
    if not text:
        return []
    spans = [
        Span("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8
    ]
    spans += [Span("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text)]
    spans += [Span("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    if _HINT.search(text):
        for kind, tokens in zip(KINDS[3:], lexed(text), strict=True):
            spans += [Span(kind, a, b, a, b) for a, b in literals(tokens)]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def mask(text: str | None) -> str | None:
    """The text with every secret value replaced."""
    places = sorted((s.value_start, s.value_end) for s in find(text))
    if not places:
        return text
    out, done = [], 0
    for a, b in places:
        if a >= done:
            out += [text[done:a], MASK]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPAN = pa.struct(
    [
        ("kind", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("value_start", pa.int64()),
        ("value_end", pa.int64()),
    ]
)


@F.arrow_udf(from_arrow_type(pa.list_(_SPAN)))
def spans(texts: pa.Array) -> pa.Array:
    """Column of all spans of a text column."""
    found = [[s._asdict() for s in find(t.as_py())] for t in texts]
    return pa.array(found, type=pa.list_(_SPAN))


@F.arrow_udf(T.StringType())
def masked(texts: pa.Array) -> pa.Array:
    """Column of the texts with their secret values replaced."""
    return pa.array([mask(t.as_py()) for t in texts], type=pa.string())


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined in their order."""
    wanted = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            wanted,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def digest(listed_spans: str) -> str:
    """What ``base_sha256`` holds, for tests and callers outside Spark."""
    return hashlib.sha256(listed_spans.encode()).hexdigest()
