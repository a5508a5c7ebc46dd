"""Merkle manifest of a dataset: roots of groups of rows and of all groups, and proofs for every row.

A leaf is the SHA-256 of a row's fields, each with its length. The leaves of a group, in order,
form a binary tree whose last node of a level may stand alone; the roots of the groups form a
tree of their own in the same way. Only every STRIDE-th level is stored: nodes are kept as rows
of one aligned subtree each, with up to 2^STRIDE digests. Building a level folds a subtree to
its one top. A proof regenerates the nodes between two stored levels from the subtree's stored
digests, emits the siblings on the way up, and lets the nodes go. Paths are extended from the
top down, one join on (tree, subtree) per stored level, so what travels is one path per subtree.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.frames import kept_in_table, quoted

#: Levels between two stored ones: a subtree has 64 leaves at most.
STRIDE = 6


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: `-` for null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha256(*map(field, values))


# ---- one subtree ---------------------------------------------------------------------------


def _folded(digests: Column) -> Column:
    """The level above: every two digests, and a last single one, become one."""

    def node(i: Column) -> Column:
        return sha256(F.get(digests, 2 * i), F.coalesce(F.get(digests, 2 * i + 1), F.lit("")))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / 2).cast("int")), node)


def _regenerated(digests: Column, height: Column) -> Column:
    """All levels of a subtree, from the stored digests up through `height` folds."""
    folds = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(folds, F.array(digests), lambda levels, _: F.concat(levels, F.array(_folded(F.element_at(levels, -1)))))


def _steps(levels: Column, height: Column, place: Column) -> Column:
    """The way of the digest at `place` to the top: each step has the sibling, null for none, and whether it is on the left."""

    def step(level: Column) -> Column:
        at = F.call_function("shiftright", place, level)
        sibling = F.get(F.get(levels, level), at.bitwiseXOR(F.lit(1)))
        return F.struct(sibling.alias("sibling"), (at.bitwiseAND(F.lit(1)) == 1).alias("left"))

    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), step)).otherwise(none)


# ---- trees ---------------------------------------------------------------------------------


def _placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Add `place`, the rank from 0 within `tree` by `order`, and `depth`, the number of levels above the leaves.

    Rows are dealt out by ranges of (tree, order), so a tree of any size is spread over tasks; what
    is added up across tasks is one count per tree and range. `order` must tell all rows apart.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = kept_in_table(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    numbered = numbered.withColumn("range", F.shiftright("at", 33))
    runs = numbered.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    leaves = F.sum("n").over(Window.partitionBy("tree"))
    runs = runs.select(
        "tree", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0).alias("depth"),
    )
    joined = numbered.join(runs, ["tree", "range"])
    return joined.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


@dataclass(frozen=True)
class Trees:
    """Stored levels of many trees. levels[j]: (tree, depth, sub, nodes), a row for each aligned subtree of level j * STRIDE,
    its nodes in order with their digests, and on the lowest level what came with each leaf (`own`)."""

    levels: list[DataFrame]
    roots: DataFrame  # (tree, root, stored): on which stored level the root is a node


def _height(j: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(STRIDE), F.col("depth") - j * STRIDE))


def _grown(placed: DataFrame, label: str) -> Trees:
    """placed: (tree, depth, place, digest, own). One job per stored level, each on 1/2^STRIDE of the rows of the one before."""
    nodes = F.array_sort(F.collect_list(F.struct("place", "digest", "own"))).alias("nodes")
    level = placed.groupBy("tree", "depth", F.shiftright("place", STRIDE).alias("sub")).agg(nodes)
    levels, roots, j = [kept_in_table(level, f"{label}-0")], None, 0
    while True:
        top = F.get(F.element_at(_regenerated(F.col("nodes.digest"), _height(j)), -1), 0)
        above = levels[-1].select("tree", "depth", F.col("sub").alias("place"), top.alias("digest"))
        above = kept_in_table(above, f"{label}-tops")
        done = F.col("depth") <= (j + 1) * STRIDE
        ended = above.filter(done).select("tree", F.col("digest").alias("root"), F.lit(j + 1).alias("stored"))
        roots = ended if roots is None else roots.unionByName(ended)
        rest = above.filter(~done)
        if rest.isEmpty():
            return Trees(levels, kept_in_table(roots, f"{label}-roots"))
        pairs = F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes")
        level = rest.groupBy("tree", "depth", F.shiftright("place", STRIDE).alias("sub")).agg(pairs)
        levels.append(kept_in_table(level, f"{label}-{j + 1}"))
        j += 1


def _proved(trees: Trees, ways: DataFrame) -> DataFrame:
    """(tree, digest, own, path, beyond) of every leaf. ways: (tree, path, beyond), how it goes on from the root of each tree."""
    roots = trees.roots.select("tree", "stored").join(ways, "tree")
    up = None
    for j in range(len(trees.levels) - 1, -1, -1):
        ended = roots.filter(F.col("stored") == j + 1).select("tree", F.lit(0).cast("long").alias("sub"), "path", "beyond")
        up = ended if up is None else up.unionByName(ended)
        level = trees.levels[j].join(up, ["tree", "sub"]).withColumn("height", _height(j))
        level = level.withColumn("regenerated", _regenerated(F.col("nodes.digest"), F.col("height")))
        level = level.select("tree", "sub", "path", "beyond", "height", "regenerated", F.explode("nodes").alias("node"))
        inside = F.col("node.place") - F.shiftleft("sub", STRIDE)
        level = level.withColumn("inside", inside.cast("int"))
        whole = F.concat(_steps(F.col("regenerated"), F.col("height"), F.col("inside")), F.col("path"))
        if not j:
            return level.select("tree", "node.digest", "node.own", whole.alias("path"), "beyond")
        up = level.select("tree", "node.place", whole.alias("path"), "beyond").withColumnRenamed("place", "sub")
        up = kept_in_table(up, "merkle-ways")
    raise AssertionError("trees have a level")


# ---- the manifest --------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots, and the root of all; null for an empty table."""

    groups: Trees
    top: Trees
    root: str | None


def manifest(rows: DataFrame, digest: Column, group: Column, order: Sequence[Column], own: Column) -> Manifest:
    """The manifest of `rows`: leaf digests ascend by `order` (nulls first), then digest, within each group.

    A null group is a group and comes first; groups ascend by their UTF-8 bytes. Rows that are equal
    in order and digest may change places, which changes nothing. `own` (a struct that can be
    compared) comes back with each proof. Each row is hashed once, also where its text is very long.
    """
    ordered = [f"o{k}" for k in range(len(order))]
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    # The salt tells equal rows apart, so that a key that many rows share can be dealt to several ranges.
    leaves = rows.select(tree.alias("tree"), *[c.alias(n) for n, c in zip(ordered, order, strict=True)], digest.alias("digest"), own.alias("own"))
    leaves = kept_in_table(leaves.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _placed(leaves, [*ordered, "digest", "salt"], "merkle-placed").select("tree", "depth", "place", "digest", "own")
    groups = _grown(placed, "merkle-groups")
    roots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("digest"))
    top = _grown(_placed(roots, ["own"], "merkle-subroots").select("tree", "depth", "place", "digest", "own"), "merkle-top")
    found = top.roots.select("root").first()
    return Manifest(groups, top, found[0] if found else None)


def proofs(made: Manifest) -> DataFrame:
    """(digest, own, path, subroot, root) of every leaf; path leads from the leaf through its group's root to the root of all."""
    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    ways = made.top.roots.select("tree", none.alias("path"), F.lit(None).cast("string").alias("beyond"))
    over = _proved(made.top, ways).select(F.col("own").alias("tree"), "path", F.col("digest").alias("beyond"))
    found = _proved(made.groups, kept_in_table(over, "merkle-over"))
    return found.select("digest", "own", "path", F.col("beyond").alias("subroot"), F.lit(made.root).cast("string").alias("root"))


def siblings(path: Column) -> Column:
    """All siblings of a path joined, from the leaf upwards."""
    return F.array_join(path["sibling"], "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path give."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.coalesce(step["sibling"], F.lit(""))
        return F.when(step["left"], sha256(sibling, node)).otherwise(sha256(node, sibling))

    return F.aggregate(path, digest, up)


def document_leaf(docs: DataFrame, n_chars: Column | None = None) -> Column:
    """The leaf of a row of `documents`, or of the same row with another n_chars."""
    values = [quoted(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    if n_chars is not None:
        values[3] = n_chars
    return leaf(*values)
