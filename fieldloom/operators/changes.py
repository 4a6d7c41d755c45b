"""A log of line changes folded into the line table, its edges and the rooms' lists of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maintain import refreshed

#: Kinds of changes; of changes with one number a removal comes first and a move last.
KINDS = ("remove", "insert", "move")
ENDS = ("x1", "y1", "x2", "y2")


def fold_changes(lines: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and edges (src, dst, type) after all changes, taken by ``seq``.

    ``changes``: seq, line_id, kind, x1, y1, x2, y2 and any other columns of ``lines``. An
    insert brings a line with both ends (and replaces one of its number, whose edges stay); a
    remove takes a line and its edges, for good even if its number comes back; a move
    overwrites the ends that it names, the others null. Moves and removals of lines that
    aren't there do nothing. Columns that an insert doesn't bring stay those of the line that
    had the number, else null. Equal numbers: by ``KINDS``, then by coordinates. Rows with a
    null seq, line_id or an unknown kind are left out; other columns are not read.

    The last to write each end and the last to insert or remove decide, so a line's changes
    are folded by maxima within a task before they are shuffled: a line with a third of all
    changes is a row a task, and the order of partitions doesn't matter.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    told = [c for c in lines.columns if c in changes.columns and c not in ("line_id", *ENDS)]
    log = changes.where("seq IS NOT NULL AND line_id IS NOT NULL").where(rank > 0).select("line_id", F.struct("seq", rank.alias("rank")).alias("_at"), "kind", *ENDS, *told)

    def writer(i: int):
        """The last row that gives end ``i``: an insert, or a move that names it."""
        writes = (F.col("kind") == "insert") | ((F.col("kind") == "move") & F.col(f"x{i}").isNotNull() & F.col(f"y{i}").isNotNull())
        return F.max(F.when(writes, F.struct("_at", F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")).alias("p"))))

    turn = F.max(F.when(F.col("kind") != "move", F.struct("_at", "kind")))
    brought = F.max(F.when(F.col("kind") == "insert", F.struct("_at", F.struct(*ENDS, *told).alias("row"))))
    last = log.groupBy("line_id").agg(turn.alias("_turn"), brought.alias("_in"), writer(1).alias("_e1"), writer(2).alias("_e2"), F.max((F.col("kind") == "remove").cast("int")).alias("_cut"))

    own = lines.select(F.col("line_id").alias("_id"), F.struct(*[c for c in lines.columns if c != "line_id"]).alias("_own"))
    met = own.join(last, F.col("_id") == F.col("line_id"), "full").withColumn("line_id", F.coalesce("line_id", "_id"))
    there = F.coalesce(F.col("_turn.kind") == "insert", F.col("_own").isNotNull() & F.col("_turn").isNull())
    value = {c: F.col(f"_own.{c}") for c in lines.columns if c != "line_id"}
    value |= {c: F.coalesce(F.col(f"_in.row.{c}"), value[c]) for c in told}
    value |= {f"{c}{i}": F.when(F.col(f"_e{i}").isNotNull(), F.col(f"_e{i}.p.{c}")).otherwise(value[f"{c}{i}"]) for i in (1, 2) for c in "xy"}
    now = met.where(there).select(*[F.col("line_id") if c == "line_id" else value[c].alias(c) for c in lines.columns])
    # only lines whose ends were written get new directions
    written = last.where("_e1 IS NOT NULL OR _e2 IS NOT NULL").select("line_id")
    kept = now.join(written, "line_id", "left_anti").unionByName(refreshed(now.join(written, "line_id", "left_semi")))

    gone = last.where("_cut = 1").select("line_id")
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("line_id").alias(end)), end, "left_anti")
    return kept.select(*lines.columns), edges.select("src", "dst", "type")


def room_changes_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """(room_id, n_lines, n_added, n_removed): how the rooms' lists of lines (rows of the line tables) change; a line that changes rooms counts in both."""
    key = ["room_id", "line_id"]
    old, new = before.select(*key).distinct().withColumn("_old", F.lit(1)), after.select(*key).distinct().withColumn("_new", F.lit(1))
    both = old.join(new, key, "full").select("room_id", F.coalesce("_old", F.lit(0)).alias("_old"), F.coalesce("_new", F.lit(0)).alias("_new"))
    return both.groupBy("room_id").agg(F.sum("_new").alias("n_lines"), F.sum(F.greatest(F.col("_new") - F.col("_old"), F.lit(0))).alias("n_added"), F.sum(F.greatest(F.col("_old") - F.col("_new"), F.lit(0))).alias("n_removed"))
