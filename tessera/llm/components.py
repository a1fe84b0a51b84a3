"""Connected components of a graph given as an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns v, root for every vertex of an edge, where root is one vertex of v's component.

    Each round hooks every vertex to its smallest neighbour (a minimum, combined map-side), follows the
    pointers to their ends by doubling, and contracts the edges. Vertices that stay are below all their neighbours, so
    no two of them are joined: of a path at most half stay, of a star all but the hub at worst, and then one in the next round.
    Rounds and doublings are written to scratch tables, each deleted when the next is there; nothing is collected but counts.
    Null ends and self loops are ignored; repeated edges change nothing. No edges: an empty table.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = table = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")), "hooks")
        while True:
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = stage(hook.join(up, "p").select("v", "p", "q"), "jumps")
            moved = not jumped.where("p <> q").isEmpty()
            hook = jumped.select("v", F.col("q").alias("p"))
            unstage(table)
            table = jumped
            if not moved:
                break
        step = hook.select("v", F.col("p").alias("root"))
        if found is None:
            found, old = step, [edges]
        else:
            next_root = step.select(F.col("v").alias("root"), F.col("root").alias("next"))
            old = [edges, table, found_table]
            found = table = stage(found.join(next_root, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "roots")
        found_table = table
        at = lambda end: hook.select(F.col("v").alias(end), F.col("p").alias(f"p{end}"))
        moved_edges = edges.join(at("a"), "a").join(at("b"), "b").where("pa <> pb")
        edges = stage(moved_edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        for x in old:
            unstage(x)
    if found is None:
        found = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return found
