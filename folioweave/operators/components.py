"""Connected components of an edge table, without collecting any group.

Rounds of least neighbour and pointer jumping: a node takes the least label among its own and its neighbours', then the
label of that label. The minimum over a node's neighbours combines before the shuffle, so a node with a third of all edges
is no hot key there; in the joins adaptive execution splits it. Each round's lineage is cut with a checkpoint.

Defined results: a node without edges is its own component; edges with a null end, loops and repeats are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import cut


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of every node (id); edges (a, b); a component is named by its least id.

    Nodes without edges never enter the rounds. The number of rounds is logarithmic in practice; running out of them
    raises instead of giving half-joined components.
    """
    clean = edges.where("a is not null and b is not null and a != b")
    both = cut(clean.select("a", "b").unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("id"), F.least("a", "l").alias("l")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = lower.join(labels.select(F.col("id").alias("l"), F.col("l").alias("ll")), "l").select("id", "was", F.least("l", "ll").alias("l"))
        step = cut(jump)
        changed = step.where("l != was").limit(1).count()
        labels = step.select("id", "l")
        if not changed:
            return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("l", "id").alias("component"))
    raise RuntimeError(f"components still change after {rounds} rounds")
