"""WARC archives: a Spark writer, and a reader that trusts only the chain of records.

The writer is Spark's text sink: a record is a string, the line separator is the blank
lines that end it. Records of equal payload are written once; the others are revisits.

The reader splits files at every occurrence of the magic line, also at those inside
payloads. A task turns each occurrence into a candidate, the offset of the record and that
of its successor, and follows the candidates of its own file block to the place where the
chain leaves the block. Pointer jumping over those block exits, from offset 0 of each file,
finds the true entry of every block; candidates that no chain reaches are payload bytes and
are dropped. Payloads that hold the magic line are put together again from their pieces, which
a second read finds by their SHA-256: where pieces begin and end doesn't depend on how a read
is split, and a record that doesn't get all its pieces back is an error.

Defined results: a null payload is empty; a null id is written without a number and read
back as null; rows that repeat the largest id of their payload are all responses; an
archive that does not start with a record has no records, and a chain that breaks ends at
the last sound record. A payload of any length is hashed in one task, whose memory grows
with it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.session import broadcast_if_small, materialize

# fixed values of the format
MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRAWL_DATE = "1970-01-01T00:00:00Z"

_BLANK = b"\r\n\r\n"
_MARK = len(MAGIC)
_CELL = 1 << 20  # grid on which payload pieces meet their record


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32, as archives write it: five hex digits make four letters."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload another row keeps.

    ``rows`` has id, digest and bytes. Copies are found from aggregated digests, so a payload
    shared by any share of the rows never gathers anywhere.
    """
    long_enough = rows.filter(F.col("bytes") >= min_bytes)
    kept = stored(
        long_enough.groupBy("digest")
        .agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL")
        .drop("n"),
        "warc-kept",
    )
    return (
        long_enough.join(kept, "digest")
        .filter("id IS NULL OR id < refers_to")
        .select("id", "digest", "refers_to")
        .distinct()
    )


def write(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
) -> None:
    """Write one record per row below ``path``.

    Payloads only move when the list of revisits is too long to broadcast (its size is
    counted); then rows meet their revisit in a shuffled join.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    slim = stored(
        pages.select(
            F.col(id_col).alias("id"),
            base32_sha1(payload.cast("binary")).alias("digest"),
            F.octet_length(payload).cast("long").alias("bytes"),
        ),
        "warc-digests",
    )
    again = broadcast_if_small(revisits(slim, min_revisit_bytes)).select(
        F.col("id").alias("copy"), F.col("digest").alias("copy_digest"), "refers_to"
    )
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    ).join(
        again,
        F.col("id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("copy_digest")),
        "left",
    )
    rows.select(_record().alias("value")).write.option("lineSep", RECORD_END).text(path)


def _name(column: Column) -> Column:
    return F.concat(
        F.lit("<urn:x-page:"),
        F.coalesce(F.url_encode(column.cast("string")), F.lit("")),
        F.lit(">"),
    )


def _record() -> Column:
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(_BLANK.decode()),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.lit("\r\nWARC-Record-ID: "),
        _name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {CRAWL_DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                _name(F.col("refers_to")),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_BLANK.decode()),
        block,
    )


# --- reading --------------------------------------------------------------------------

_SEGMENT = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("rel", pa.int64()),
        ("size", pa.int64()),
        ("span", pa.int64()),
        ("exit", pa.int64()),
        ("type", pa.string()),
        ("name", pa.string()),
        ("refers", pa.string()),
        ("declared", pa.string()),
        ("bytes", pa.int64()),
        ("digest", pa.string()),
        ("whole", pa.bool_()),
        ("key", pa.binary()),
    ]
)
_SEGMENT_SQL = (
    "file string, block long, rel long, size long, span long, exit long, type string, "
    "name string, refers string, declared string, bytes long, digest string, whole boolean, key binary"
)
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


def _fields(head: bytes) -> dict[bytes, str] | None:
    found = {}
    for line in head.split(b"\r\n"):
        m = _FIELD.fullmatch(line)
        if not m:
            return None
        found[m[1].lower()] = m[2].decode("utf-8", "replace").strip()
    return found


def _payload(fields: dict[bytes, str], body: bytes) -> tuple[int, str]:
    """Bytes and digest of the payload; those a revisit left out come from its headers."""
    head, blank, payload = body.partition(_BLANK)
    if not fields.get(b"content-type", "").startswith("application/http") or not blank:
        head, payload = b"", body
    if fields.get(b"warc-type") == "revisit":
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        declared = fields.get(b"warc-payload-digest", "")
        return int(size[1]) if size else 0, declared.removeprefix("sha1:")
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse(segment: bytes) -> dict:
    """What follows a magic line, read as a record; an empty dict if it is none."""
    head, blank, _ = segment.partition(_BLANK)
    fields = _fields(head) if blank else None
    if fields is None or not re.fullmatch("[0-9]{1,18}", fields.get(b"content-length", "")):
        return {}
    start, length = len(head) + len(_BLANK), int(fields[b"content-length"])
    found = {
        "span": _MARK + start + length + len(_BLANK),
        "type": fields.get(b"warc-type"),
        "name": fields.get(b"warc-record-id"),
        "refers": fields.get(b"warc-refers-to"),
        "declared": fields.get(b"warc-payload-digest", "").removeprefix("sha1:"),
        "whole": start + length + len(_BLANK) == len(segment) and segment.endswith(_BLANK),
    }
    if found["whole"]:
        found["bytes"], found["digest"] = _payload(fields, segment[start : start + length])
    return found


def _walk(batches: Iterator[pa.RecordBatch]):
    """(file, block, offset in the block, bytes, key) of the segments of the task's blocks."""
    at, rel = None, 0
    for batch in batches:
        for file, block, value, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (file, block):
                at, rel = (file, block), 0
            yield file, block, rel, value, key
            rel += len(value) + _MARK


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []

    def close() -> pa.RecordBatch:
        # where the chain from each candidate leaves the block
        end = rows[-1]["rel"] + rows[-1]["size"]
        exits: dict[int, int | None] = {}
        for row in reversed(rows):
            if "span" in row:
                after = row["rel"] - _MARK + row["span"]
                row["exit"] = exits.get(after, after if after >= end else None)
                exits[row["rel"] - _MARK] = row["exit"]
        return pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)

    for file, block, rel, value, key in _walk(batches):
        if rows and (rows[-1]["file"], rows[-1]["block"]) != (file, block):
            yield close()
            rows = []
        row = {"file": file, "block": block, "rel": rel, "size": len(value), "key": key}
        if block > 0 or rel > 0:  # what precedes the first magic line is no record
            row |= _parse(value)
        rows.append(row)
    if rows:
        yield close()


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines; ``key`` names the bytes."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
        .withColumn("key", F.unhex(F.sha2("value", 256)))
    )


def _reached(edges: DataFrame) -> DataFrame:
    """(file, at) of the block entries on the chain from offset 0.

    ``edges`` maps a candidate to its block's exit. Only exits matter from here on, a few per
    block; each round doubles the length of the jumps.
    """
    starts = edges.select("file").distinct().select("file", F.lit(0).cast("long").alias("at"))
    nodes = starts.union(edges.select("file", F.col("to").alias("at")).distinct()).distinct()
    jumps = materialize(nodes.join(edges, ["file", "at"]).filter("to IS NOT NULL"))
    reached, n = materialize(starts), -1
    while (size := reached.count()) != n:
        n = size
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.union(ahead).distinct())
        twice = jumps.select("file", F.col("to").alias("mid"), F.col("at").alias("start")).join(
            jumps.select("file", F.col("at").alias("mid"), "to"), ["file", "mid"]
        )
        jumps = materialize(twice.select("file", F.col("start").alias("at"), "to"))
    return reached


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one block that its entries lead to."""
    after = dict(zip(rows["at"], rows["at"] + rows["span"], strict=True))
    true = set()
    for at in rows.loc[rows["entry"], "at"]:
        while at in after and at not in true:
            true.add(at)
            at = after[at]
    return rows[rows["at"].isin(true)].drop(columns="entry")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All true records: file, offset, record_type, record_id, refers_to, payload_bytes,
    payload_digest, digest_ok."""
    seg = stored(_segments(spark, path).mapInArrow(_candidates, _SEGMENT_SQL), "warc-segments")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        seg.groupBy("file", "block")
        .agg(F.sum(F.col("size") + _MARK).alias("total"))
        .select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    placed = stored(
        seg.join(blocks, ["file", "block"]).select(
            *(c for c in seg.columns if c != "exit"),
            (F.col("base") + F.col("rel") - _MARK).alias("at"),
            (F.col("base") + F.col("exit")).alias("to"),
        ),
        "warc-placed",
    )
    candidates = placed.filter("span IS NOT NULL")
    reached = _reached(candidates.select("file", "at", "to"))
    entries = reached.withColumn("entry", F.lit(True))
    kept = ["file", "block", "at", "span", "size", "type", "name", "refers", "declared"]
    kept += ["bytes", "digest", "whole"]
    marked = candidates.join(entries, ["file", "at"], "left").select(
        *kept, F.coalesce("entry", F.lit(False)).alias("entry")
    )
    schema = marked.drop("entry").schema
    true = stored(marked.groupBy("file", "block").applyInPandas(_follow_block, schema), "warc-true")
    broken = true.filter("NOT whole")
    records = true.filter("whole")
    if not broken.isEmpty():
        records = records.unionByName(_reassembled(spark, path, broken, placed).select(*kept))
    return records.select(
        "file",
        F.col("at").alias("offset"),
        F.col("type").alias("record_type"),
        F.col("name").alias("record_id"),
        F.col("refers").alias("refers_to"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        (F.col("digest") == F.col("declared")).alias("digest_ok"),
    )


def _follow_block(rows: pd.DataFrame) -> pd.DataFrame:
    out = _follow(rows)
    for column in ("bytes",):
        out[column] = out[column].astype("Int64")
    return out


def _reassembled(
    spark: SparkSession, path: str, broken: DataFrame, placed: DataFrame
) -> DataFrame:
    """The records whose payload holds the magic line, from the segments they cover.

    Segments meet their record on a grid of offsets, so no file gathers in one task; one
    record does, as its digest needs. Their bytes are read again and found by key, so that
    the second read may be split in any way.
    """
    cells = broken.select(
        "file",
        F.col("at").alias("record"),
        (F.col("at") + F.col("span")).alias("end"),
        F.explode(
            F.sequence(
                F.floor(F.col("at") / _CELL), F.floor((F.col("at") + F.col("span")) / _CELL)
            )
        ).alias("cell"),
    )
    covered = placed.select("file", "at", "key", F.floor(F.col("at") / _CELL).alias("cell"))
    parts = stored(
        covered.join(cells, ["file", "cell"])
        .filter("at >= record AND at < end")
        .select("file", "record", "at", "key"),
        "warc-parts",
    )
    wanted = broadcast_if_small(parts.select("key").distinct())
    # equal keys are equal bytes
    content = (
        _segments(spark, path)
        .select("key", "value")
        .join(wanted, "key")
        .groupBy("key")
        .agg(F.first("value").alias("value"))
    )
    joined = stored(
        parts.join(stored(content, "warc-content"), "key")
        .groupBy("file", "record")
        .applyInPandas(
            _join_pieces, "file string, at long, pieces long, bytes long, digest string"
        ),
        "warc-joined",
    )
    got = joined.agg(F.count("*").alias("n"), F.sum("pieces").alias("pieces")).first()
    if (got["n"], got["pieces"]) != (broken.count(), parts.count()):
        raise RuntimeError("the archives have changed between two reads")
    sound = joined.filter("digest IS NOT NULL").drop("pieces")
    return broken.drop("bytes", "digest").join(sound, ["file", "at"])


def _join_pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """Bytes and digest of one record; neither if its end isn't sound."""
    data = MAGIC.encode().join(rows.sort_values("at")["value"])
    head, _, rest = data.partition(_BLANK)
    fields = _fields(head) or {}
    length = int(fields[b"content-length"])
    size = digest = None
    if rest[length : length + len(_BLANK)] == _BLANK:
        size, digest = _payload(fields, rest[:length])
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "file": [first["file"]],
            "at": [first["record"]],
            "pieces": [len(rows)],
            "bytes": pd.array([size], dtype="Int64"),
            "digest": [digest],
        }
    )


def page_id(name: str) -> Column:
    """The id in a record name, null if it holds none."""
    inner = F.regexp_extract(name, r"^<urn:x-page:(.*)>$", 1)
    return F.when(inner != "", F.url_decode(inner))
