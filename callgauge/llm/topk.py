"""Exact top-k inner products, a block of vectors at a time.

Vectors are quantised to integers. The index cuts them into blocks of neighbouring ids and
keeps, per block, a forward index (its vectors) and the largest and smallest value of every
component. A query's products with those extremes add up to a bound that no vector of the
block exceeds. A task holds one run of blocks and lets the queries stream past it in groups:
each query visits the run's blocks in the order of their bounds and stops where the bound falls
below its k-th best score so far, so skipped blocks cannot change the result.

Every block moves once, every query once per run: that is the stated query set against all
rows, in blocks. Runs and groups have a greatest size, which bounds the memory of a task;
components move in the narrowest integer type that holds them.

Defined results: vectors that are null or hold nulls, NaN or infinities take no part, nor do
rows without an id; of rows that repeat an id the largest vector (by its components) stands
for all; vectors are only compared with those of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.session import broadcast_if_small

SCALE = 64
K = 20
BLOCK = 512
RUN = 64  # most blocks held at a time
GROUP = 1024  # queries searched at a time
TASKS = 10_000  # most tasks; with more runs a task takes several in turn


def quantised(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that cannot take part."""
    column = F.col(vector) if isinstance(vector, str) else vector
    doubles = column.cast("array<double>")
    sound = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


_PACK = pa.schema(
    [
        ("dim", pa.int32()),
        ("n", pa.int32()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("vectors", pa.binary()),
        ("high", pa.binary()),
        ("low", pa.binary()),
    ]
)
_PACK_SQL = "dim int, n int, width int, ids binary, vectors binary, high binary, low binary"


def _width(values: np.ndarray) -> int:
    """Bytes of the narrowest integer type that holds all values."""
    low, high = values.min(initial=0), values.max(initial=0)
    return next(w for w in (2, 4, 8) if np.iinfo(f"i{w}").min <= low and high <= np.iinfo(f"i{w}").max)


def _pack(rows: int):
    """Rows (dim, id, vec) in order, packed by ``rows``."""

    def run(batches):
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def close():
            dim = held[0][0]
            ids = np.concatenate([i for _, i, _ in held])
            vectors = np.concatenate([v for _, _, v in held]).reshape(len(ids), dim)
            high = vectors.max(axis=0) if dim else vectors[0]
            low = vectors.min(axis=0) if dim else vectors[0]
            width = _width(vectors)
            return pa.RecordBatch.from_pydict(
                {
                    "dim": [dim],
                    "n": [len(ids)],
                    "width": [width],
                    "ids": [ids.astype("<i8").tobytes()],
                    "vectors": [vectors.astype(f"<i{width}").tobytes()],
                    "high": [high.astype(f"<i{width}").tobytes()],
                    "low": [low.astype(f"<i{width}").tobytes()],
                },
                schema=_PACK,
            )

        for batch in batches:
            dims = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(dims)])
            at = 0
            while at < len(dims):
                have = sum(len(i) for _, i, _ in held)
                if held and (held[0][0] != dims[at] or have == rows):
                    yield close()
                    held, have = [], 0
                same = np.flatnonzero(dims[at:] != dims[at])
                stop = min(at + rows - have, at + same[0] if len(same) else len(dims))
                held.append((int(dims[at]), ids[at:stop], values[ends[at] : ends[stop]]))
                at = stop
        if held:
            yield close()

    return run


def _packed(vectors: DataFrame, rows: int, parts: int, label: str) -> DataFrame:
    return stored(
        vectors.repartitionByRange(parts, "dim", "id")
        .sortWithinPartitions("dim", "id")
        .select("dim", "id", "vec")
        .mapInArrow(_pack(rows), _PACK_SQL)
        .withColumn("part", F.spark_partition_id()),
        label,
    )


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(who, score, ids, k):
    """The k best (score, then id) of each query, from flat arrays."""
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    first = np.searchsorted(who, who)
    top = np.arange(len(who)) - first < k
    return who[top], score[top], ids[top]


def search_run(
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
    query_ids: np.ndarray,
    queries: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, score, id) of each query's k best in a run of blocks; blocks scored.

    A block is (ids, vectors, high, low).
    """
    n = len(queries)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    high = np.stack([b[2] for b in blocks])
    low = np.stack([b[3] for b in blocks])
    bounds = _product(up, high) + _product(down, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    least = np.iinfo(np.int64).min
    kth = np.full(n, least)
    who = np.empty(0, np.int64)
    score, ids = who.copy(), who.copy()
    scored = 0
    for step in range(len(blocks)):
        turn = order[:, step]
        # equal to the k-th is still of interest: a smaller id wins
        open_ = np.flatnonzero(bounds[np.arange(n), turn] >= kth)
        if not len(open_):
            break
        scored += len(open_)
        fresh = []
        for b in np.unique(turn[open_]):
            mine = open_[turn[open_] == b]
            block_ids, vectors = blocks[b][0], blocks[b][1]
            products = _product(queries[mine], vectors)
            floor = kth[mine]
            if products.shape[1] > k:
                floor = np.maximum(floor, np.partition(products, -k - 1, axis=1)[:, -k - 1])
            hit, place = np.nonzero(products >= floor[:, None])
            other = block_ids[place] != query_ids[mine[hit]]
            hit, place = hit[other], place[other]
            part = _best(hit, products[hit, place], block_ids[place], k)
            fresh.append((mine[part[0]], part[1], part[2]))
        who, score, ids = _best(
            *(np.concatenate(x) for x in zip((who, score, ids), *fresh, strict=True)), k
        )
        full = np.bincount(who, minlength=n) >= k
        last = np.searchsorted(who, np.arange(n), side="right") - 1
        if len(score):
            kth = np.where(full, score[last], least)
    return who, score, ids, scored


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _unpacked(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = f"<i{pack['width']}"
    vectors, high, low = (
        np.frombuffer(pack[c], kind).astype(np.int64) for c in ("vectors", "high", "low")
    )
    return np.frombuffer(pack["ids"], "<i8"), vectors.reshape(pack["n"], pack["dim"]), high, low


def _search(k: int):
    """Packs sorted by (part, dim, asks): a run's blocks, then the queries that pass it."""

    def run(batches):
        place, blocks = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                pack = batch.slice(n, 1).to_pylist()[0]
                if (pack["part"], pack["dim"]) != place:
                    place, blocks = (pack["part"], pack["dim"]), []
                if not pack["asks"]:
                    blocks.append(_unpacked(pack))
                elif blocks:
                    query_ids, vectors, _, _ = _unpacked(pack)
                    who, score, ids, _ = search_run(blocks, query_ids, vectors, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (query_ids[who], ids, score)], schema=_FOUND
                    )

    return run


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    block: int = BLOCK,
    run: int = RUN,
    group: int = GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row."""
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            quantised(vector_col, scale).alias("vec"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .filter("id IS NOT NULL AND vec IS NOT NULL")
        .groupBy("id")
        .agg(F.max("vec").alias("vec"), F.max("asks").alias("asks"))
        .withColumn("dim", F.size("vec"))
    )
    rows = stored(rows, "vectors")
    n = rows.count()
    # as many runs as cores where there are blocks enough
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    runs = max(1, -(-n // (block * run)), min(-(-n // block), cores))
    index = _packed(rows, block, runs, "blocks")
    # a run gives k rows per query, so their number follows the rows, not the partitions
    parts = index.agg(F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()["last"] + 1
    if parts > runs:
        index = index.withColumn("part", F.expr(f"int(part * {runs}L div {parts})"))
    queries = rows.filter("asks")
    asked = _packed(queries, group, max(1, -(-queries.count() // group)), "queries")
    # ranges of (dim, id): the runs that hold a dimension are neighbours
    held = index.groupBy("dim").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    passing = asked.drop("part").join(broadcast_if_small(held), "dim")
    passing = passing.withColumn("part", F.explode(F.sequence("first", "last"))).drop("first", "last")
    tasks = min(runs, TASKS)
    packs = (
        index.withColumn("asks", F.lit(False))
        .unionByName(passing.withColumn("asks", F.lit(True)))
        .repartitionById(tasks, F.pmod("part", F.lit(tasks)))
        .sortWithinPartitions("part", "dim", "asks")
    )
    found = packs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
