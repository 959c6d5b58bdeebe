"""Connected components by alternating large-star and small-star steps.

All state is a table of edges in the shared folder; the driver sees one row of counts per round.  A hub's edges are
pre-aggregated (a minimum per node) and joined back, so no task gathers a node's neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large star: every larger neighbour of u links to the least of u and its neighbours;
    small star: u and its smaller neighbours link to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of the undirected edges (a, b).

    Null ends and loops are ignored; repeated edges count once; no edges give no rows."""
    a, b = F.col("a"), F.col("b")
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct(), "edges"
    )
    state = None
    for _ in range(rounds):
        new = materialize(_star(_star(now, True), False), "edges")
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())
        discard(now)
        now = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
