"""Connected components of a link table by contraction, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): component is the smallest node reachable. links: two columns a, b of one orderable type, no nulls.

    Each round maps every node to the neighbour (or itself) of smallest rank, where the rank is a hash, so that the nodes
    left shrink by a constant factor; links are then renamed and made distinct. Minima are partial sums before the shuffle,
    and joins are plain equi-joins that Spark can split where a node is hot. The chain of maps is applied backwards.
    """
    kind = links.schema["a"].dataType
    rank = lambda c: F.struct(F.xxhash64(F.lit(1), c).alias("r"), c.alias("v"))
    rest = staged(links.select("a", "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if rest.isEmpty():
        return links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        both = rest.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        step = staged(low.select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("to")), "map")
        maps.append(step)
        left = rest.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        named = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").filter("ta != tb")
        rest = staged(named.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        if rest.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    # a node that a later round doesn't know stands for its whole component
    top = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = top.withColumnRenamed("node", "to")
        top = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    top = staged(top, "roots")
    least = top.groupBy("root").agg(F.min("node").alias("component"))
    return top.join(least, "root").select("node", "component")
