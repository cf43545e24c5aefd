"""Merkle manifest of a dataset: a digest per row, one per group, one of all, and proofs.

Rows are leaves. Per group they are put in order, and every three consecutive nodes become their
parent until one is left, the group's root; the groups' roots in order of the groups give the
root of all in the same way.

Proofs are made by pointer jumping. A node begins with the digests of its siblings, which take it
to its parent. Each round joins the nodes to their own kind: a node that knows the way to the
ancestor 2**k levels up appends what that ancestor knows and so reaches 2**(k+1) levels up. After
log2(height) rounds every leaf holds its whole way to the root.

Nothing is kept in one task. Places in a group come from a sort by ranges and the number of rows
before each range. A task sees blocks of ``3**FOLDED`` leaves when parents are made. A round
joins nodes by blocks of at most as many, so ancestors of a third of all rows are met in as many
places as their descendants fill. Everything is Spark's own functions.

Defined results: nulls enter a digest as ``-``; a null group is a group of its own and the first;
rows of equal order are ordered by their digests, and repeated rows are leaves of their own; an
empty table has no rows and no root; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.session import discard, materialize

#: Children of a node, and levels that are folded from one block of ``ARITY**FOLDED`` nodes.
ARITY, FOLDED = 3, 4
BLOCK = ARITY**FOLDED
#: Hex digits of a digest.
DIGEST = 64


def field(value: Column) -> Column:
    """A value as it enters a digest: length in bytes, colon, text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def levels_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    powers = F.array(*(F.lit(ARITY**k) for k in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


def nodes_at(n: Column, level: Column | int) -> Column:
    """Nodes of a level of a tree of ``n`` leaves."""
    power = F.pow(F.lit(ARITY).cast("double"), F.lit(level) if isinstance(level, int) else level)
    return F.floor((n - 1) / power) + 1


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with ``tree``) with ``pos`` from 0 in its tree and ``n``, the tree's size.

    The rows are dealt by ranges of (tree, order) and numbered inside each range; the rows of a
    tree in earlier ranges, a number per range and tree, are added. Rows that are equal in all
    of it are told apart by where they were read, so they can be dealt to several ranges.
    """
    dealt = (
        leaves.withColumn("_read", F.monotonically_increasing_id())
        .repartitionByRange("tree", *order, "_read")
        .sortWithinPartitions("tree", *order, "_read")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .drop("_read")
    )
    numbered = materialize(dealt, "merkle-leaves")
    parts = numbered.groupBy("tree", "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    # One row per range and tree, so no key has more leaves than a range.
    return numbered.join(starts, ["tree", "_part"]).select(
        "tree", "hash", "item", (F.col("_at") + F.col("_shift")).alias("pos"), "n"
    )


def _above(hashes: str) -> str:
    """Parents of consecutive digests that begin at a multiple of three."""
    return (
        f"transform(sequence(0, (size({hashes}) - 1) div {ARITY}), i -> "
        f"sha2(array_join(slice({hashes}, {ARITY} * i + 1, {ARITY}), ''), 256))"
    )


def _siblings(hashes: str) -> str:
    """For the node at ``i`` the digests of the rest of its run, as bytes."""
    run = f"slice({hashes}, {ARITY} * (i div {ARITY}) + 1, {ARITY})"
    return f"unhex(array_join(filter({run}, (x, j) -> j <> i % {ARITY}), ''))"


def tree_nodes(leaves: DataFrame) -> list[DataFrame]:
    """Tables of all nodes of the trees: ``tree, n, level, pos, hash, item, way``.

    ``leaves`` is ``tree, n, pos, hash, item``; ``item`` stays with the leaves. ``way`` holds the
    digests of the siblings; it is empty for a root, and null for nodes that the next table has
    again. ``FOLDED`` levels are made at a time from blocks of consecutive nodes, so there are a
    quarter as many rounds as levels, each on a small part of the rows of the one before.
    """
    none = f"CAST(NULL AS {leaves.schema['item'].dataType.simpleString()})"
    tables: list[DataFrame] = []
    rest = leaves.withColumn("level", F.lit(0))
    while True:
        blocks = rest.groupBy("tree", "level", F.expr(f"pos div {BLOCK}").alias("block")).agg(
            F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("pos", "hash", "item"))).alias("nodes"),
        )
        made = blocks.withColumn("items", F.col("nodes.item")).withColumn("h0", F.col("nodes.hash"))
        # A level is made as long as the tree has more than one node on the one below it.
        for k in range(1, FOLDED + 1):
            more = nodes_at(F.col("n"), F.col("level") + (k - 1)) > 1
            above = F.when(more, F.expr(_above(f"h{k - 1}")))
            made = made.withColumn(f"h{k}", F.coalesce(above, F.array().cast("array<string>")))

        def nodes(k: int, item: str, way: str) -> str:
            return (
                f"transform(h{k}, (h, i) -> named_struct('level', level + {k}, "
                f"'pos', block * {ARITY ** (FOLDED - k)} + i, 'hash', h, 'item', {item}, 'way', {way}))"
            )

        ways = [f"CASE WHEN size(h{k + 1}) > 0 THEN {_siblings(f'h{k}')} ELSE X'' END" for k in range(FOLDED)]
        parts = [nodes(k, none if k else "items[i]", way) for k, way in enumerate(ways)]
        parts.append(nodes(FOLDED, none, "CAST(NULL AS binary)"))
        node = F.explode(F.expr(f"concat({', '.join(parts)})")).alias("node")
        tables.append(materialize(made.select("tree", "n", node).select("tree", "n", "node.*"), "merkle-nodes"))
        rest = tables[-1].where(F.col("way").isNull()).drop("way")
        if rest.isEmpty():
            return tables


def complete(tables: list[DataFrame]) -> DataFrame:
    """Every node once, with its way."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole.where(F.col("way").isNotNull())


def joined_ways(tables: list[DataFrame]) -> DataFrame:
    """The leaves with ``way``, the digests of all siblings up to the root; deletes ``tables``.

    A round of distance d joins the nodes on levels that are multiples of 2 d to those d levels
    above them. Below ``FOLDED`` levels an ancestor has at most ``BLOCK`` descendants; further
    up it goes to every block of that many descendants.
    """
    nodes = complete(tables)
    height = nodes.agg(F.max(levels_of(F.col("n")))).first()[0] or 0
    d = 1
    while True:
        level, near = F.col("level"), min(d, FOLDED)
        low = nodes.where(level % (2 * d) == 0).withColumn(
            "block", F.expr(f"pos div {ARITY**near}")
        )
        spread = ARITY ** (d - near)
        below = nodes_at(F.col("n"), level - d)
        last = F.least(
            (F.col("pos") + 1) * spread - 1, F.floor((below - 1) / ARITY**near)
        ).cast("long")
        high = nodes.where(level % (2 * d) == d).select(
            "tree",
            (level - d).alias("level"),
            F.explode(F.sequence((F.col("pos") * spread).cast("long"), last)).alias("block"),
            F.col("way").alias("further"),
        )
        met = low.join(high, ["tree", "level", "block"], "left").select(
            "tree", "n", "level", "pos", "hash", "item",
            F.concat("way", F.coalesce("further", F.lit(b""))).alias("way"),
        )
        nodes = materialize(met, "merkle-ways")
        discard(*tables)
        tables, d = [nodes], 2 * d
        if d >= height:
            return nodes.where(F.col("level") == 0)


def folded(leaf: Column, way: Column, pos: Column, n: Column) -> Column:
    """Digest of the root that a leaf, as hex, and its way lead to."""
    steps = F.sequence(F.lit(0), levels_of(n) - 1)

    def step(so_far: Column, level: Column) -> Column:
        power = F.pow(F.lit(ARITY).cast("double"), level)
        at = F.floor(pos / power)
        before = at % ARITY
        run = F.least(F.lit(ARITY), nodes_at(n, level) - at + before)
        text, used = so_far["hash"], so_far["used"]
        left = F.substring(way, (used + 1).cast("int"), (before * DIGEST).cast("int"))
        right = F.substring(
            way, (used + before * DIGEST + 1).cast("int"), ((run - 1 - before) * DIGEST).cast("int")
        )
        return F.struct(
            F.sha2(F.concat(left, text, right), 256).alias("hash"),
            (used + (run - 1) * DIGEST).cast("long").alias("used"),
        )

    start = F.struct(leaf.alias("hash"), F.lit(0).cast("long").alias("used"))
    climbed = F.aggregate(steps, start, step)["hash"]
    return F.when(n > 1, climbed).otherwise(leaf)


def hex_way(way: Column) -> Column:
    return F.lower(F.hex(way))


def manifest(
    rows: DataFrame, columns: Sequence[str], group: str, order: str, keep: dict[str, Column] | None = None
) -> DataFrame:
    """Per row its digest and its way to the root of all.

    Gives ``item`` (the row's ``order`` column as ``key``, and the columns of ``keep``), ``leaf``
    of the given columns in their order, ``subroot`` of its group, ``root``, and per tree ``way``
    (hex digests of the siblings, level by level), ``pos`` and ``n``; those of the groups' tree
    begin with ``group_``.
    """
    kept = [column.alias(name) for name, column in (keep or {}).items()]
    leaves = rows.select(
        # A null group comes first, and cannot be one that has a name.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        F.col(order).alias("key"),
        digest([F.col(c) for c in columns]).alias("hash"),
        F.struct(F.col(order).alias("key"), *kept).alias("item"),
    )
    # Written before it is dealt by ranges: Spark samples what it deals, and would hash all
    # texts a second time for that.
    hashed = materialize(leaves, "merkle-digests")
    nodes = tree_nodes(placed(hashed, ["key", "hash"]))
    is_root = levels_of(F.col("n")) == F.col("level")
    tops = complete(nodes).where(is_root).select(
        F.lit("").alias("tree"),
        "hash",
        F.struct(F.col("tree").alias("name"), F.col("n").alias("size")).alias("item"),
        F.col("tree").alias("name"),
    )
    above = tree_nodes(placed(tops, ["name"]))
    # The root is one digest, whatever the table's size.
    root = complete(above).where(is_root).select("hash").first()
    span = BLOCK**2
    groups = joined_ways(above).select(
        F.col("item.name").alias("tree"),
        F.col("hash").alias("subroot"),
        F.col("way").alias("group_way"),
        F.col("pos").alias("group_pos"),
        F.col("n").alias("group_n"),
        # A group goes to as many places as it has blocks of rows.
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(item.size - 1) div {span}"))).alias("block"),
    )
    found = joined_ways(nodes).withColumn("block", F.expr(f"pos div {span}"))
    discard(hashed)
    return found.join(groups, ["tree", "block"]).select(
        "item",
        F.col("hash").alias("leaf"),
        hex_way(F.col("way")).alias("way"),
        "pos",
        "n",
        "subroot",
        hex_way(F.col("group_way")).alias("group_way"),
        "group_pos",
        "group_n",
        F.lit(root["hash"] if root else None).cast("string").alias("root"),
    )


def root_of(leaf: Column) -> Column:
    """Root that ``leaf`` leads to by the ways of a row of a manifest."""
    subroot = folded(leaf, F.col("way"), F.col("pos"), F.col("n"))
    return folded(subroot, F.col("group_way"), F.col("group_pos"), F.col("group_n"))
