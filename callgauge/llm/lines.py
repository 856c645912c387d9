"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if the share of the host's pages that contain it exceeds a
ratio. Lines are counted once per page, by their 128-bit digest, so texts do not move for
the counts. A host can have at most (lines per page / ratio) boilerplate lines, which makes
the list that pages are cleaned with short whatever the host's size; it is broadcast if its
counted rows allow, and else joined by host, where adaptive execution splits a hot host.

Markup is taken out in linear time: in pages with more than a few openings, those without an
end are recognised by lying behind the last end in the page, and are never searched from.
Lines are stored once and read twice.

Defined results: a null or empty text has no lines and stays an empty text; a null host is
a site of its own; repeated rows are separate pages; hosts with fewer than ``min_pages``
pages keep all lines, and lines on fewer than ``min_seen`` pages of a host stay; pages of any
length are split whole, in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.session import BROADCAST_ROWS, materialize

# fixed lists: elements without visible text, and elements that start a new line
UNSEEN = ("script", "style", "template", "noscript")
BLOCKS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table "
    "tbody td tfoot th thead title tr ul"
).split()

MAX_RATIO = 0.2
MIN_PAGES = 5


def host_of(url: str | Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    column = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(
        F.lower(column), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1
    )
    return F.when(host != "", host)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FEW = 64  # searches through the rest of a page that are made without a closer look
_HIDDEN = "\ufdd0"  # a code point that no text may hold, for a ``<`` that opens nothing


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(text: Column, mark: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the text up to its last ``mark`` and of the rest; A-Z of the text count as a-z."""
    plain = F.translate(text, _UPPER, _UPPER.lower())
    rest = F.char_length(F.substring_index(plain, mark, -1))
    return _named(rest, lambda n: use(F.left(text, F.char_length(text) - n), F.right(text, n)))


def _without_tags(text: Column, tag: str, instead: str) -> Column:
    """Replace tags, each of which ends with the next ``>``; after the last one there is none."""

    def replaced(t: Column) -> Column:
        tail = F.substring_index(t, ">", -1)
        open_ = F.char_length(tail) - F.char_length(F.replace(tail, F.lit("<"), F.lit("")))
        linear = _cut(t, ">", lambda head, rest: F.concat(F.regexp_replace(head, tag, instead), rest))
        return F.when(open_ <= _FEW, F.regexp_replace(t, tag, instead)).otherwise(linear)

    return _named(text, replaced)


def _without_unseen(text: Column) -> Column:
    """Replace elements that are not shown, and comments, from their start to their end.

    A start behind the last end of its kind has none. If there are many starts, such ones are
    hidden from the pattern, which would look for their end through the rest of the page.
    """
    kinds = [*((rf"(?i)<(?={e}\b)", f"</{e}>") for e in UNSEEN), ("<(?=!--)", "-->")]
    starts = rf"(?i)<(?:!--|(?:{'|'.join(UNSEEN)})\b)"
    unseen = "(?is)" + "|".join([*(rf"<{e}\b.*?</{e}>" for e in UNSEEN), "<!--.*?-->"])

    def hide(start: str, end: str) -> Callable[[Column], Column]:
        return lambda t: _cut(
            t, end, lambda head, tail: F.concat(head, F.regexp_replace(tail, start, _HIDDEN))
        )

    hidden = text
    for kind in kinds:
        hidden = _named(hidden, hide(*kind))
    return F.when(
        F.regexp_count(text, F.lit(starts)) <= _FEW, F.regexp_replace(text, unseen, " ")
    ).otherwise(F.translate(F.regexp_replace(hidden, unseen, " "), _HIDDEN, "<"))


def html_lines(html: str | Column) -> Column:
    """Visible text of a page, one line per block element."""
    column = F.col(html) if isinstance(html, str) else html
    text = _without_unseen(F.coalesce(column, F.lit("")))
    text = F.regexp_replace(text, r"[\r\n]", " ")
    text = _without_tags(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    return text_lines(_without_tags(text, "<[^>]*>", ""))


def text_lines(text: str | Column) -> Column:
    """The non-empty lines of a text, without outer spaces."""
    column = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(F.coalesce(column, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame,
    *,
    id_col: str,
    host: Column,
    lines: Column,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    min_seen: int = 1,
    broadcast_lines: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per page: id, host, n_lines, n_dropped, and the text of the lines that stay."""
    rows = stored(
        pages.select(
            F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines")
        ),
        "page-lines",
    )
    totals = (
        rows.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    )
    counts = (
        rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", F.md5(F.col("line").cast("binary")).alias("line"))
        .agg(F.count("*").alias("n"))
    )
    common = materialize(
        counts.join(totals, "host")
        .filter((F.col("n") > F.col("pages") * F.lit(max_ratio)) & (F.col("n") >= min_seen))
        .select("host", "line")
    )
    by_host = common.groupBy("host").agg(F.collect_list("line").alias("common"))
    if common.limit(broadcast_lines + 1).count() <= broadcast_lines:  # 32 bytes each
        by_host = F.broadcast(by_host)
    else:
        by_host = stored(by_host, "common-lines")
    none = F.array().cast("array<string>")
    kept = F.filter(
        "lines",
        lambda x: ~F.array_contains(F.col("common"), F.md5(x.cast("binary"))),
    )
    cleaned = rows.join(by_host, "host", "left").select(
        "id", "host", "lines", F.coalesce("common", none).alias("common")
    )
    return cleaned.select(
        "id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")
    ).select(
        "id",
        "host",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
