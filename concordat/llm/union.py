"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import cut


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node that it reaches.

    Large star: each node hands its larger neighbours to its smallest neighbour. Small star: it
    hands its smaller ones to the smallest. Edges only shrink in number, and a hub's edges meet its
    minimum in a join that adaptive execution can split, never in one collected group. Self links
    are allowed and give a node without others its own root. Nulls are ignored.
    """
    links = links.select("a", "b").dropna()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def mark(e: DataFrame) -> tuple:
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large.a == least.u)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
