"""Merkle manifest of a dataset: a tree for each group of rows, one over the groups, a proof for each row.

Rows get their place in their group by ranges.  Every aligned block of places
becomes one node, blocks of blocks likewise, until each group has one node, its
top; the tops are leaves of a last tree.  Proofs go the other way: each block
joins the proof of its own node with the authentication paths inside, which a
fractal traversal emits leaf after leaf from a few stacked subtrees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordering import placed
from netloom.plans.shared import materialize, quoted

#: Levels of the tree that one block holds (2 ** LEVELS places), and of each stacked subtree.
LEVELS, SUBTREE = 9, 3

Node = bytes | None


def joined(left: Node, right: Node) -> Node:
    """Digest of a run of two nodes, of which the right or both may be missing."""
    return None if left is None else sha256(left + (right or b"")).hexdigest().encode()


class Subtree:
    """Nodes of one subtree from its lowest level up to below its top, hashed from the leaves step by step.

    A step takes the next leaf or joins the two topmost nodes of the stack; nodes
    below the lowest level are forgotten as soon as they are joined.
    """

    def __init__(self, leaves: list[bytes], low: int, high: int, number: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next = number << high
        self.end = self.next + (1 << high)
        self.nodes: dict[tuple[int, int], Node] = {}
        self.stack: list[tuple[int, int, Node]] = []

    def _put(self, level: int, place: int, node: Node) -> None:
        if self.low <= level < self.high:
            self.nodes[level, place] = node
        self.stack.append((level, place, node))

    def grow(self, steps: int) -> None:
        for _ in range(steps):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (_, _, right), (level, place, left) = self.stack.pop(), self.stack.pop()
                self._put(level + 1, place >> 1, joined(left, right))
            elif self.next < self.end:
                self._put(0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
                self.next += 1
            else:
                return

    def finish(self) -> Subtree:
        self.grow(2 << self.high)
        return self


def authentication_paths(leaves: list[bytes], levels: int, height: int = SUBTREE) -> Iterator[list[Node]]:
    """The siblings of each leaf, lowest level first, of a tree of ``levels`` levels; None where a node has none.

    Fractal traversal: every band of ``height`` levels keeps the existing subtree
    that the current leaf is below, and the desired one right of it, which grows
    by two steps for each leaf and so is whole when the leaves enter it.  What
    is held beside the leaves is two subtrees for each band.
    """
    bands = [(low, min(low + height, levels)) for low in range(0, levels, height)]
    existing = [Subtree(leaves, low, high, 0).finish() for low, high in bands]
    # The topmost subtree spans all leaves, so nothing follows it.
    desired = [Subtree(leaves, low, high, 1) for low, high in bands[:-1]]
    for place in range(len(leaves)):
        yield [existing[level // height].nodes[level, (place >> level) ^ 1] for level in range(levels)]
        for k, tree in enumerate(desired):
            tree.grow(2)
            if not (place + 1) % (1 << tree.high):
                existing[k] = tree.finish()
                desired[k] = Subtree(leaves, tree.low, tree.high, ((place + 1) >> tree.high) + 1)


def _levels(n: int, most: int) -> int:
    """Levels that a block rises by: all of them below a further level of blocks, else those up to the top."""
    return min(most, (n - 1).bit_length())


def _digests(column: pa.ChunkedArray) -> list[bytes]:
    return [d.hex().encode() for d in column.to_pylist()]


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each aligned block of ``nodes``."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        g, n, place = (table.column(c)[0].as_py() for c in ("g", "n", "place"))
        row: list[Node] = _digests(table.column("digest"))
        for _ in range(_levels(n, levels)):
            row = [joined(row[i], row[i + 1] if i + 1 < len(row) else None) for i in range(0, len(row), 2)]
        return pa.table({"g": pa.array([g], pa.string()), "n": [-(-n >> levels)], "place": [place >> levels], "digest": pa.array([bytes.fromhex(row[0].decode())], pa.binary())})

    # n rounded up: -(-n >> levels) is the number of blocks.
    return nodes.select("g", "n", "place", "digest", _block(levels)).groupBy("g", "block").applyInArrow(solve, "g string, n long, place long, digest binary")


def _block(levels: int) -> Column:
    return F.shiftright("place", levels).alias("block")


def prove(nodes: DataFrame, most: int, beyond: Callable[[DataFrame], DataFrame], levels: int = LEVELS, height: int = SUBTREE) -> DataFrame:
    """Proofs of ``nodes`` (``g, n, place, digest`` and more), each up to its group's one node and on.

    ``most`` is the largest n of a group.  ``beyond`` gets the groups' last nodes
    (``g, digest``) and adds to them the columns ``proof``, ``subroot``
    and ``root``, with which every proof ends.
    """
    if most <= 1:
        return beyond(nodes)
    blocks = materialize(_blocks(nodes, levels), "merkle-blocks")
    above = prove(blocks, -(-most >> levels), beyond, levels, height)
    above = above.select("g", F.col("place").alias("block"), "proof", "subroot", "root")
    rest = [f for f in nodes.schema.fields if f.name not in ("n",)]
    kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rest)

    def solve(below: pa.Table, top: pa.Table) -> pa.Table:
        below = below.sort_by("place")
        n = below.column("n")[0].as_py()
        place = below.column("place").to_pylist()
        end, subroot, root = top.column("proof")[0].as_py(), top.column("subroot")[0].as_py(), top.column("root")[0].as_py()
        proofs = []
        for at, path in zip(place, authentication_paths(_digests(below.column("digest")), _levels(n, levels), height)):
            # A sibling is on the left of every odd node.
            proofs.append([("" if s is None else ("l" if at >> k & 1 else "r") + s.decode()) for k, s in enumerate(path)] + end)
        out = below.select([f.name for f in rest])
        for name, values, kind in (("proof", proofs, pa.list_(pa.string())), ("subroot", [subroot] * len(place), pa.string()), ("root", [root] * len(place), pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    left = nodes.select("*", _block(levels)).groupBy("g", "block")
    return left.cogroup(above.groupBy("g", "block")).applyInArrow(solve, f"{kinds}, proof array<string>, subroot string, root string")


def field_digest(values: dict[str, Column]) -> Column:
    """Digest of a row's fields in order, each ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its proof give: at each level its sibling stands to the left, to the right, or is missing."""

    def up(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.sha2(F.when(sibling.startswith("l"), F.concat(other, node)).when(sibling.startswith("r"), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof, from the leaf's to the last tree's."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def merkle_manifest(
    rows: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", changes: dict[str, Column] | None = None, changed: Column | None = None, levels: int = LEVELS, height: int = SUBTREE
) -> DataFrame:
    """Manifest of ``rows``: ``id, leaf, presented, subroot, root, proof`` for each.

    A leaf is the digest of the row's ``fields``.  Leaves of a group ascend by id;
    every two consecutive nodes, or one that is left over, become their digest,
    until one is left, the group's ``subroot``.  Subroots in order of the groups,
    null first and then by their bytes, give ``root`` in the same way.  ``proof`` has one
    text for each level: ``l`` or ``r``, where the sibling stands, and its
    digest, or an empty text if there is none.  ``presented`` is the leaf of
    the row as ``changes`` (expressions by field) make it where
    ``changed`` holds, else the leaf; a proof refutes it unless it is the same.

    Null ids come first in their group and null groups are one group; rows with
    equal ids are ordered by their leaves, so that equal rows, which have equal
    leaves, may stand in any order.  A single row's leaf is subroot and root,
    with an empty proof.  An empty table gives an empty result.  Values other
    than texts are taken as their text.  Whole texts are read once, to hash them;
    shuffles carry digests, ids and proofs of blocks only.
    """
    value = {f: F.col(quoted(f)) for f in fields}
    leaf = field_digest(value)
    other = leaf if changes is None else F.when(changed, field_digest(value | changes)).otherwise(leaf)
    presented = F.when(F.coalesce(changed, F.lit(False)), F.unhex(other)) if changes is not None else F.lit(None).cast("binary")
    # Digests are written before anything orders them, so sampling for ranges reads no text.
    leaves = rows.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(group_col)).cast("string").alias("g"), F.unhex(leaf).alias("digest"), presented.alias("presented"))
    places = materialize(placed(materialize(leaves, "merkle-leaves"), ["g"], ["id", "digest"], "place", "n"), "merkle-places")

    def over_groups(tops: DataFrame) -> DataFrame:
        """The last tree: its leaves are the groups' own nodes, in the order of the groups."""
        subroots = tops.select(F.lit("all").alias("g"), F.col("g").alias("group"), F.col("place").alias("group_place"), "digest")

        def last(roots: DataFrame) -> DataFrame:
            text = F.lower(F.hex("digest"))
            return roots.withColumns({"proof": F.array().cast("array<string>"), "subroot": text, "root": text})

        proven = prove(materialize(placed(subroots, ["g"], ["group"], "place", "n"), "merkle-tops"), groups, last, levels, height)
        return proven.select(F.col("group").alias("g"), F.col("group_place").alias("place"), "proof", F.lower(F.hex("digest")).alias("subroot"), "root")

    sizes = places.agg(F.max("n").alias("most"), F.count(F.when(F.col("place") == 0, 1)).alias("groups")).first()
    most, groups = sizes["most"] or 0, sizes["groups"]
    if most <= 1:
        above = over_groups(places).select(F.col("g").alias("group"), "proof", "subroot", "root")
        below = places.join(above, F.col("g").eqNullSafe(F.col("group")))
    else:
        below = prove(places, most, over_groups, levels, height)
    leaf_text = F.lower(F.hex("digest"))
    return below.select("id", leaf_text.alias("leaf"), F.coalesce(F.lower(F.hex("presented")), leaf_text).alias("presented"), "subroot", "root", "proof")
