"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import materialize


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every node in a link.

    Alternating large-star and small-star steps; each round is aggregations and joins over
    the links, written to the shared folder, so neither a component nor the link list is
    held by one task or the driver. Rounds grow with the logarithm of the longest path.
    """
    e = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    before = None
    for i in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{i}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first()
        if now == before:
            stars = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def connect_components(members: DataFrame, key: str = "room_id", weight: float = 1e-10) -> DataFrame:
    """Edges that chain the components of each graph: by order of their smallest node, between the nodes of closest numbers.

    ``members``: key, node, root. Returns key, p, q (p < q), weight.
    """
    roots = members.select(key, "root").distinct()
    chained = roots.withColumn("next_root", F.lead("root").over(Window.partitionBy(key).orderBy("root"))).where("next_root IS NOT NULL")
    a = members.select(key, "root", F.col("node").alias("a"))
    b = members.select(key, F.col("root").alias("next_root"), F.col("node").alias("b"))
    pairs = chained.join(a, [key, "root"]).join(b, [key, "next_root"])
    best = pairs.groupBy(key, "root", "next_root").agg(F.min(F.struct(F.abs(F.col("a") - F.col("b")).alias("d"), "a", "b")).alias("m"))
    return best.select(key, F.least("m.a", "m.b").alias("p"), F.greatest("m.a", "m.b").alias("q"), F.lit(weight).alias("weight"))


def connected(edges: DataFrame, nodes: DataFrame, key: str = "room_id") -> DataFrame:
    """Edges (key, p, q, weight) and those that chain the components of each graph's nodes (key, node), nodes without an edge included."""
    root = components(edges.select(F.col("p").alias("a"), F.col("q").alias("b")), "graph-cc")
    members = nodes.select(key, "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return edges.select(key, "p", "q", "weight").unionByName(connect_components(members, key))


def laplacian(edges: DataFrame, key: str = "room_id") -> DataFrame:
    """Entries (key, i, j, value) of I - D^-1/2 W D^-1/2 for undirected edges p, q, weight; nodes without edges have none."""
    both = edges.select(key, F.col("p").alias("i"), F.col("q").alias("j"), "weight").unionByName(edges.select(key, F.col("q").alias("i"), F.col("p").alias("j"), "weight"))
    degree = both.groupBy(key, "i").agg(F.sum("weight").alias("d"))
    other = degree.select(key, F.col("i").alias("j"), F.col("d").alias("dj"))
    off = both.join(degree, [key, "i"]).join(other, [key, "j"]).select(key, "i", "j", (-F.col("weight") / F.sqrt(F.col("d") * F.col("dj"))).alias("value"))
    return off.unionByName(degree.select(key, "i", F.col("i").alias("j"), F.lit(1.0).alias("value")))
