"""Merkle manifest of a dataset: one tree per group of rows and one over the groups.

Rows are numbered within their group by one range sort: a partition's rows take their place
in it plus the rows of the group in earlier partitions, so a large group is spread over many
tasks. Each level then is a self-join: every node asks for its siblings by their computed
numbers (XOR for a binary tree, else slot offsets), and the row in slot zero emits the
parent, the hash of its run. On the way back down, a node's path is the siblings to the left
and right of it and its parent's path, so proofs are joins of a run's number as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<l: string, r: string>>"
#: Rows of a group that meet its number or its root together.
BLOCK = 4096


def field_bytes(col: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**values: Column) -> Column:
    """Lower-case hex sha256 of a row's fields, in the order of the keywords."""
    return F.sha2(F.concat(*[field_bytes(v) for v in values.values()]), 256)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``idx``: their place, from 0 on, within their group (none: all rows) by ``order``, nulls first.

    Only the counts of a partition's groups meet in a window: one row a partition of a
    group, never the rows themselves. Rows alike in all of ``order`` are numbered either way.
    """
    keys = [*group, *order]
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = placed.groupBy(F.col("_part").alias("_p"), *named).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))], F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    same = reduce(lambda c, i: c & F.col(group[i]).eqNullSafe(F.col(f"_g{i}")), range(len(group)), F.col("_part") == F.col("_p"))
    return placed.join(offset, same).withColumn("idx", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base", *offset.columns[:-1])


def siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (tree, idx, h and more) with l and r: the hashes of their run's other nodes before and after them, joined.

    A node asks for all numbers of its run, its own included; only hashes are copied.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "idx")]
    slot, shift = F.col("idx") % fan, F.col("_shift")
    want = F.col("idx").bitwiseXOR(shift) if fan == 2 else F.col("idx") - slot + (slot + shift) % fan
    asked = nodes.select("tree", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))).alias("_shift")).withColumn("_want", want).drop("_shift")
    other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.struct(*rest).alias("_own"))
    met = asked.join(other, (F.col("tree") == F.col("_tree")) & (F.col("_want") == F.col("_idx")))
    met = met.select("tree", "idx", "_want", F.when(F.col("_want") != F.col("idx"), F.col("_own.h")).alias("_h"), F.when(F.col("_want") == F.col("idx"), F.col("_own")).alias("_own"))
    side = lambda where: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("_want", "_h")))), lambda s: s["_h"]), "")
    sides = met.groupBy("tree", "idx").agg(F.first("_own", True).alias("_own"), side(F.col("_want") < F.col("idx")).alias("l"), side(F.col("_want") > F.col("idx")).alias("r"))
    return sides.select("tree", "idx", "_own.*", "l", "r")


def grow(leaves: DataFrame, fan: int, name: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(single, levels, roots) of the trees over leaves (tree, idx, h and more).

    single: the leaves that are alone in their tree. levels: the nodes of each level with n
    (nodes of the tree's level), l and r. roots: (tree, root), what remains of each tree.

    A tree of one leaf has that leaf as its root. A run of a single node is hashed too.
    """
    sizes = leaves.groupBy(F.col("tree").alias("_tree"), _block("idx")).agg(F.count("*").alias("_n"))
    totals = sizes.join(sizes.groupBy("_tree").agg(F.sum("_n").alias("n")), "_tree").drop("_n")
    nodes = leaves.join(totals, (F.col("tree") == F.col("_tree")) & (_block("idx") == F.col("_block"))).drop("_tree", "_block")
    nodes, levels, roots = materialize(nodes, f"{name}-0"), [], []
    single = nodes.where("n = 1").drop("n")
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.col("h").alias("root")))
        many = nodes.where("n > 1")
        if many.isEmpty():
            return single, levels, reduce(DataFrame.unionByName, roots)
        level = materialize(siblings(many, fan), f"{name}-level{len(levels)}")
        levels.append(level)
        parent = F.sha2(F.concat("l", "h", "r"), 256).alias("h")
        up = level.where(F.col("idx") % fan == 0).select("tree", _run("idx", fan).alias("idx"), parent, _run("n + " + str(fan - 1), fan).alias("n"))
        nodes = materialize(up, f"{name}-{len(levels)}")


def _block(idx: str) -> Column:
    return F.expr(f"{idx} div {BLOCK}").alias("_block")


def _run(idx: str, fan: int) -> Column:
    return F.expr(f"({idx}) div {fan}")


def paths(levels: list[DataFrame], tops: DataFrame, fan: int, name: str) -> DataFrame | None:
    """The first level's nodes with ``tops``' columns and path: the siblings (l, r) of each level up to the root, then the path of ``tops`` (tree, path and more).

    None if no tree has two leaves.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops.select(F.col("tree").alias("_t"), F.col("path").alias("_up"), *more)
    found = None
    for i, level in reversed(list(enumerate(levels))):
        named = level.drop("l", "r", "n") if i == 0 else level.select("tree", "idx")
        joined = level.where(F.col("n") <= fan).join(above, F.col("tree") == F.col("_t"))  # their parent is the root
        if found is not None:
            parents = found.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_up"), *more)
            inner = level.where(F.col("n") > fan).join(parents, (F.col("tree") == F.col("_t")) & (_run("idx", fan) == F.col("_i"))).drop("_i")
            joined = joined.unionByName(inner)
        found = joined.select(*named.columns, *more, F.concat(F.array(F.struct("l", "r")), "_up").alias("path"))
        if i:
            found = materialize(found, f"{name}-path{i}")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of a path's siblings from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(docs: DataFrame, fan: int = 16, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, group, leaf, altered, subroot, root, path) of every row; ``path`` leads from the leaf via the group's root to the root.

    Leaves of a group ascend by id (null first, then by their hash, so repeated rows each
    have a leaf); groups ascend bytewise, null first. ``altered`` is the leaf of the row with
    the text's A-Z lower-cased. Null fields and empty texts have hashes of their own; columns
    other than ``fields`` do not enter. An empty table gives no rows.
    """
    if fan < 2:
        raise ValueError("a run needs two nodes or more")
    as_is = {f: F.col(f) for f in fields}
    hashed = docs.select(
        F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf_hash(**as_is).alias("h"), leaf_hash(**as_is | {text_col: ascii_lower(F.col(text_col))}).alias("_altered")
    )
    rows = materialize(numbered(materialize(hashed, "leaves"), ["_group"], ["_id", "h"], "leaves-sorted"), "leaves-numbered")
    # groups' numbers go to their rows by blocks, so that no task meets all rows of a large group
    names = materialize(numbered(rows.where("idx = 0").select("_group"), [], ["_group"], "groups-sorted"), "groups").select(F.col("_group").alias("_name"), F.col("idx").alias("tree"))
    blocks = rows.select(F.col("_group").alias("_of"), _block("idx")).distinct().join(names, F.col("_of").eqNullSafe(F.col("_name"))).drop("_name")
    leaves = rows.join(blocks, F.col("_group").eqNullSafe(F.col("_of")) & (_block("idx") == F.col("_block"))).drop("_of", "_block")

    single, levels, subroots = grow(leaves, fan, "leaf-tree")
    subroots = materialize(subroots, "subroots")
    one, top_levels, root = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("h")), fan, "group-tree")
    start = root.select("tree", "root", F.array().cast(STEP).alias("path"))  # one row
    above = paths(top_levels, start, fan, "group-tree")
    above = one.join(start, "tree") if above is None else above
    tops = materialize(above.select(F.col("idx").alias("tree"), F.col("h").alias("subroot"), "root", "path"), "group-paths")
    full = single.join(tops, "tree")
    below = paths(levels, tops, fan, "leaf-tree")
    full = full if below is None else full.unionByName(below)
    return full.select(F.col("_id").alias(id_col), F.col("_group").alias(group_col), F.col("h").alias("leaf"), F.col("_altered").alias("altered"), "subroot", "root", "path")
