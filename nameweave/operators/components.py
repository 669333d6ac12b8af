"""Connected components by contraction: every node joins a neighbour by an order that is drawn anew each round, and the merged graph goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameweave.scratch import Table


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable,
    as no merge ever gives a node a larger parent.

    Nulls and self-loops are no edges. No task holds a whole component: neighbours are only ever folded by min(),
    rows is about how many edges there are, if that is known. A node goes with the first of itself and its neighbours by a hash that differs from round to
    round, and on to that one's first, and what meets there is named by its smallest node. So about a third of the nodes are left after a round also where
    ids rise along a path, of which the smallest neighbour would only ever take off the ends.
    """
    edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    left = Table(_undirected(edges), "edges", rows=rows)
    merged: list[Table] = []
    while n := left.count():
        both = left.df.union(left.df.select("b", "a"))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(merged)), c).alias("h"), F.col(c).alias("p"))
        parent = both.groupBy("a").agg(F.min(drawn("b")).alias("f")).select(F.col("a").alias("node"), F.least(drawn("a"), "f")["p"].alias("p"))
        once = Table(parent, "parents", rows=2 * n)
        up = once.df.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        met = Table(once.df.join(up, "p").select("node", F.col("pp").alias("p")), "parents2", rows=2 * n)
        once.drop()
        names = met.df.groupBy("p").agg(F.min("node").alias("name"))
        twice = Table(met.df.join(names, "p").select("node", F.col("name").alias("p")), "names", rows=2 * n)
        met.drop()
        ends = twice.df
        nxt = (
            left.df.join(ends.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
            .join(ends.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        )
        nxt = Table(_undirected(nxt), "edges", rows=n)
        left.drop()
        left = nxt
        merged.append(twice)
    left.drop()
    if not merged:
        return edges.sparkSession.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    label = merged[0].df.select("node", F.col("p").alias("component"))
    for t in merged[1:]:
        hop = t.df.select(F.col("node").alias("component"), F.col("p").alias("next"))
        label = label.join(hop, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return label
