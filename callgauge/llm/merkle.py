"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, proofs.

Rows of a group are numbered by id. Level by level, nodes see their run (``arity`` consecutive
nodes) through lag and lead columns of fixed offsets, masked by the node's slot in the run and
the run's length; these are its siblings, and the run's first row hashes the parent. Windows
are partitioned by stretches of whole runs, so no group gathers in one task. Every level is
stored. From the root down, each node hands its path to its children: level tables shrink
geometrically, so the whole way down moves about one leaf level's paths.

H is SHA-256 in lower-case hex over concatenated inputs, digests as hex text.

Defined results: an empty table has no nodes; null fields are ``-`` in a leaf; rows without
group form the first group; rows without id come first in theirs, and rows that repeat an id
are ordered by their leaf; texts of any length are hashed whole where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.common import stored
from callgauge.llm.numbering import numbered
from callgauge.session import broadcast_if_small

ARITY = 2
STRETCH = 1 << 9  # runs of one window partition
STORE_EVERY = 6  # levels of paths that one plan goes down
_PATH = "array<struct<left:binary,right:binary>>"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H of texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: its length in bytes, a colon, itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _grown(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, pos, n, hash) of one level with left and right siblings and the parent.

    A tree's last node left has neither.
    """
    slot = F.col("pos") % arity
    # the length of the node's run: the last one of a tree may be shorter
    length = F.least(F.lit(arity), F.col("n") - F.col("pos") + slot)
    stretch = F.expr(f"pos div {arity * STRETCH}")
    order = Window.partitionBy("tree", stretch).orderBy("pos")
    before = [
        F.when(slot >= k, F.lag("hash", k).over(order)).otherwise("") for k in range(arity - 1, 0, -1)
    ]
    after = [
        F.when(slot + k < length, F.lead("hash", k).over(order)).otherwise("")
        for k in range(1, arity)
    ]
    many = F.col("n") > 1
    seen = nodes.select(
        "*", F.concat(*before).alias("left"), F.concat(*after).alias("right"), slot.alias("slot")
    )
    return seen.withColumn(
        "parent", F.when(many & (F.col("slot") == 0), digest(F.col("hash"), F.col("right")))
    )


def levels(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels over leaves (tree, pos, n, hash), stored; further columns stay with the leaves.

    A tree's root is the only node of its last level: n is 1 there.
    """
    largest = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    found, nodes = [], leaves
    while True:
        grown = stored(_grown(nodes, arity), f"merkle-{len(found)}")
        found.append(grown)
        if largest <= 1:
            return found
        largest = -(-largest // arity)
        nodes = grown.filter("parent IS NOT NULL").select(
            "tree",
            F.expr(f"pos div {arity}").alias("pos"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.col("parent").alias("hash"),
        )


def roots(found: Sequence[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [level.filter("n = 1").select("tree", F.col("hash").alias("root")) for level in found]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def paths(found: Sequence[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``: their siblings per level, upwards, and then those ``above``.

    ``above`` has (tree, path) for every tree.
    """
    own = F.array(F.struct(F.unhex("left").alias("left"), F.unhex("right").alias("right")))
    top = None
    for i in range(len(found) - 1, -1, -1):
        level = found[i]
        alone = level.filter("n = 1").join(above, "tree").select(level["*"], "path")
        below = level.filter("n > 1")
        if top is None:
            top = alone
            continue
        parents = top.select(
            "tree", F.col("pos").alias("parent_pos"), F.col("path").alias("parent_path")
        )
        inner = below.withColumn("parent_pos", F.expr(f"pos div {arity}")).join(
            parents, ["tree", "parent_pos"]
        )
        top = alone.unionByName(
            inner.select(*level.columns, F.concat(own, "parent_path").alias("path"))
        )
        if i and i % STORE_EVERY == 0:  # plans stay short; the large levels are not written
            top = stored(top.select("tree", "pos", "path"), f"merkle-path-{i}")
    return top


def _text(hashes: Column) -> Column:
    return F.lower(F.hex(hashes))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's hash and its siblings."""
    return F.aggregate(
        path, start, lambda at, s: digest(_text(s["left"]), at, _text(s["right"]))
    )


def proof(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    parts = F.transform(path, lambda s: _text(F.concat(s["left"], s["right"])))
    return digest(F.array_join(parts, ""))


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = _FIELDS,
    changed: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path, proof_sha256, current.

    ``current`` is the leaf with the fields in ``changed`` replaced (null: as it is), to be
    checked against the manifest by ``folded``.
    """
    changed = changed or {}
    now = leaf(*(changed.get(c, F.col(c)) for c in fields)) if changed else F.lit(None)
    differs = F.lit(False)
    for name, value in changed.items():
        differs |= ~value.eqNullSafe(F.col(name))
    leaves = docs.select(
        F.col(id_col).alias("id"),
        F.col(group_col).cast("string").alias("grp"),
        leaf(*(F.col(c) for c in fields)).alias("hash"),
        F.when(differs, now).alias("current"),
    )
    placed = numbered(leaves, ["id", "hash"], ["grp"])
    # groups become numbers; there may be as many groups as rows
    groups = numbered(placed.filter("pos = 0").select("grp"), ["grp"]).select(
        F.col("grp").alias("__grp"), F.col("pos").alias("tree")
    )
    found = levels(
        placed.join(broadcast_if_small(groups), F.col("grp").eqNullSafe(F.col("__grp"))).select(
            "id", "hash", "current", "tree", "pos", "n"
        ),
        arity,
    )
    subroots = stored(roots(found), "merkle-subroots")
    trees, one = F.lit(subroots.count()).cast("long"), F.lit(0).cast("long")
    upper = levels(
        subroots.select(
            one.alias("tree"), F.col("tree").alias("pos"), trees.alias("n"), F.col("root").alias("hash")
        ),
        arity,
    )
    top = roots(upper)
    root = top.first()
    nothing = top.select("tree", F.array().cast(_PATH).alias("path"))
    above = stored(
        paths(upper, nothing, arity).select(
            F.col("pos").alias("tree"), "path", F.col("hash").alias("subroot")
        ),
        "merkle-above",
    )
    return (
        paths(found, above.select("tree", "path"), arity)
        .join(broadcast_if_small(above.select("tree", "subroot")), "tree")
        .select(
            "id",
            F.col("hash").alias("leaf"),
            "subroot",
            F.lit(root["root"] if root else None).cast("string").alias("root"),
            "path",
            proof(F.col("path")).alias("proof_sha256"),
            F.coalesce("current", "hash").alias("current"),
        )
    )
