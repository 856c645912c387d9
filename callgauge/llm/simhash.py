"""SimHash near-duplicates: fingerprints, and all links within a bit distance.

Links are found by the generalised pigeonhole principle. The 64 bits are grouped so that
correlated bits share a partition; partition i gets a threshold t_i, -1 for "not used",
with sum(t_i) = distance - partitions + 1. Two fingerprints within the distance then differ
in at most t_i bits in some partition. Dynamic programming picks the thresholds, and the
number of partitions, with the least estimated work, from counts over all fingerprints.

Equal fingerprints are one node. A key that more than ``BUCKET`` of them share is not
paired: its fingerprints, and those that probe it, spread to all patterns within half the
distance and link to the least fingerprint at each pattern. Two fingerprints meet at such a
pattern exactly if they are within the distance, so that way is exact too, and linear.

Words are split at ASCII white space after lower-casing A-Z. Defined results: fewer words
than a shingle make one shingle; no words (null, empty) give fingerprint zero, which links
like any other; rows with the same id share the component their smallest link gives.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import stored, utf8
from callgauge.llm.graph import components

BITS = 64
SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
BUCKET = 32
_CHUNK = 1 << 16  # hashes counted at a time


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text as an unsigned number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), min(shingle, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(joined[a:b], SEED)
            for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)
        ),
        dtype="<u8",
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        rows = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column, as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([simhash(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return run(utf8(text))


# --- planning -------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _co_occurrence(batches):
    total = np.zeros((BITS, BITS))
    for batch in batches:
        values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        rows = values.view(np.uint8).reshape(-1, 8)
        for i in range(0, len(rows), _CHUNK):
            ones = np.unpackbits(rows[i : i + _CHUNK], axis=1, bitorder="little").astype(np.float64)
            total += ones.T @ ones
    yield pa.RecordBatch.from_pydict(
        {
            "i": pa.array(np.arange(BITS), type=pa.int32()),
            "n": pa.array([row.astype(np.int64).tolist() for row in total]),
        }
    )


def bit_correlations(prints: DataFrame) -> np.ndarray:
    """Correlation of every two bits over all fingerprints (column fp)."""
    n = prints.count()
    sums = (
        prints.select("fp")
        .mapInArrow(_co_occurrence, "i int, n array<long>")
        .select("i", F.posexplode("n").alias("j", "n"))
        .groupBy("i", "j")
        .agg(F.sum("n").alias("n"))
        .collect()  # 64 x 64 numbers
    )
    both = np.zeros((BITS, BITS))
    for r in sums:
        both[r.i, r.j] = r.n
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Equally large groups of bits; each grows by the bit most correlated with it."""
    strength = np.abs(correlation) - np.eye(BITS)
    free = set(range(BITS))
    groups = []
    for size in (BITS // parts + (i < BITS % parts) for i in range(parts)):
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: strength[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], budget: int) -> list[int]:
    """One threshold per partition, summing to ``budget``, with the least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, extra in options.items():
                key, value = spent + t, cost + extra
                if key not in after or value < after[key][0]:
                    after[key] = (value, [*chosen, t])
        best = after
    return best[budget][1]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks that flip up to ``radius`` of the given bits."""
    return [_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def plan(prints: DataFrame, distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, from counts over all fingerprints."""
    n = prints.count()
    correlation = bit_correlations(prints)
    options = {m: group_bits(correlation, m) for m in range(max(2, distance), distance + 3)}
    keys = [(m, i, _mask(g)) for m, groups in options.items() for i, g in enumerate(groups)]
    shared = F.array(
        *[
            F.struct(
                F.lit(m).alias("m"),
                F.lit(i).alias("i"),
                F.col("fp").bitwiseAND(F.lit(k)).alias("key"),
            )
            for m, i, k in keys
        ]
    )
    size = F.col("n").cast("double")
    pairs = F.least(size * (size - 1) / 2, size * F.lit(float(BUCKET)))
    counted = (
        prints.select(F.explode(shared).alias("k"))
        .groupBy("k")
        .agg(F.count("*").alias("n"))
        .groupBy("k.m", "k.i")
        .agg(F.sum(pairs).alias("pairs"))
        .collect()  # one row per partition
    )
    found = {(r.m, r.i): r.pairs for r in counted}
    best = None
    for m, groups in options.items():
        budget = distance - m + 1
        costs = []
        for i, bits in enumerate(groups):
            options_i = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                # candidates spread about as evenly over the neighbouring keys
                options_i[t] = n * (1 + probes * (t > 0)) + found.get((m, i), 0.0) * probes
            costs.append(options_i)
        chosen = allocate(costs, budget)
        cost = sum(c[t] for c, t in zip(costs, chosen, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


# --- probing --------------------------------------------------------------------------


def _keyed(prints: DataFrame, chosen: list[tuple[list[int], int]], radius: bool) -> DataFrame:
    """(i, key, fp) rows; with ``radius`` also the keys within each partition's threshold."""
    entries = []
    for i, (bits, t) in enumerate(chosen):
        if radius and t == 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        for flip in _ball(bits, t) if radius else [0]:
            entries.append(
                F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(flip)).alias("key"))
            )
    if not entries:
        return prints.select(F.lit(0).alias("i"), F.col("fp").alias("key"), "fp").filter("false")
    return prints.select(F.explode(F.array(*entries)).alias("k"), "fp").select(
        "k.i", "k.key", "fp"
    )


def links(
    prints: DataFrame,
    distance: int = MAX_DISTANCE,
    chosen: list[tuple[list[int], int]] | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (distinct, column fp) in reach."""
    chosen = chosen if chosen is not None else plan(prints, distance)
    index = _keyed(prints, chosen, radius=False)
    probes = _keyed(prints, chosen, radius=True)
    exact = [i for i, (_, t) in enumerate(chosen) if t == 0]
    sizes = stored(
        index.groupBy("i", "key")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") > 1) | ~F.col("i").isin(exact)),
        "simhash-keys",
    )
    light = index.join(sizes.filter(F.col("n") <= bucket).drop("n"), ["i", "key"])
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    right = light.withColumnRenamed("fp", "b")
    left = light.filter(F.col("i").isin(exact)).unionByName(probes).withColumnRenamed("fp", "a")
    found = left.join(right, ["i", "key"]).filter(near).select("a", "b")
    crowded = sizes.filter(F.col("n") > bucket).drop("n")
    dense = (
        index.unionByName(probes).join(crowded, ["i", "key"]).select("fp").distinct()
    )
    return found.unionByName(dense_links(dense, distance)).distinct()


def dense_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links that connect the given fingerprints exactly as all their pairs in reach would.

    Two fingerprints are within r + R bits exactly if a pattern is within r of one and R of
    the other, r and R being the halves of the distance.
    """
    short, wide = distance // 2, distance - distance // 2
    masks = _ball(list(range(BITS)), wide)
    inner = len(_ball(list(range(BITS)), short))
    patterns = prints.select(
        "fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("at", "mask")
    ).select(
        "fp",
        F.col("fp").bitwiseXOR(F.col("mask")).alias("pattern"),
        (F.col("at") < inner).alias("close"),
    )
    centres = (
        patterns.groupBy("pattern")
        .agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
        .filter("n > 1 AND a IS NOT NULL")
        .drop("n")
    )
    return (
        patterns.join(centres, "pattern")
        .filter("a <> fp")
        .select("a", F.col("fp").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per document: id, fp, component (the smallest id that links reach)."""
    rows, parts = _parts(docs, id_col, text_col, shingle, distance)
    smallest = stored(
        parts.groupBy("part").agg(F.min("least").alias("component")), "simhash-smallest"
    )
    named = parts.join(smallest, "part").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def _parts(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int
) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every document; (fp, least, part): its smallest id, and its group's name."""
    rows = stored(
        docs.select(F.col(id_col).alias("id"), fingerprint(text_col, shingle).alias("fp")),
        "simhash",
    )
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-prints")
    grouped = components(links(prints.select("fp"), distance))
    parts = prints.join(grouped, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part")
    )
    return rows, parts


def keep(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The row with the smallest id of each group, with all its columns.

    A group without ids keeps its smallest fingerprint. Where that id or its absence occurs
    in several rows, the smallest digest of those with the fingerprint stays; only rows that
    repeat both id and text stay together.
    """
    rows, parts = _parts(docs, id_col, text_col, shingle, distance)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    stay = stored(
        parts.groupBy("part")
        .agg(first)
        .select(F.col("first.least").alias("__id"), F.col("first.fp").alias("__fp")),
        "simhash-stay",
    )
    repeated = stored(
        rows.groupBy(F.col("id").alias("__id"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1 OR __id IS NULL")
        .select("__id"),
        "simhash-repeated",
    )
    same_id = F.col(id_col).eqNullSafe(F.col("__id"))
    if repeated.isEmpty():
        return docs.join(stay, same_id, "left_semi")
    plain = stay.join(repeated, "__id", "left_anti").filter("__id IS NOT NULL")
    doubtful = docs.join(repeated, same_id, "left_semi").withColumns(
        {"__mark": fingerprint(text_col, shingle), "__sha": F.sha2(utf8(text_col), 256)}
    )
    doubtful = stored(
        doubtful.join(stay, same_id & (F.col("__mark") == F.col("__fp")), "left_semi"),
        "simhash-doubtful",
    )
    least = doubtful.groupBy("__mark").agg(F.min("__sha").alias("__sha"))
    kept = doubtful.join(stored(least, "simhash-least"), ["__mark", "__sha"], "left_semi")
    return docs.join(plain, same_id, "left_semi").unionByName(kept.select(docs.columns))
