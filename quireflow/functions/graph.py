"""Graph work as rounds of joins: connected components and chains of next-pointers.

Every round is written to the shared checkpoint folder, which cuts the lineage and survives the loss of executors. What
a later round replaces is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.session import release, settle


def components(nodes: DataFrame, edges: DataFrame, scope: Sequence[str], node: str = "node", out: str = "component") -> DataFrame:
    """Labels each node with the smallest node of its connected component.

    `edges` has columns scope + (a, b). Each round takes the smallest label among a node and its neighbours and then
    jumps to the label's own label, so long chains close in a logarithmic number of rounds; labels only fall, so the rounds
    end. Both steps aggregate with min before the shuffle, so a node with very many neighbours costs its tasks one row each.
    """
    scope = list(scope)
    both = settle(
        edges.select(*scope, F.explode(F.array(
            F.struct(F.col("a").alias(node), F.col("b").alias("__to")), F.struct(F.col("b").alias(node), F.col("a").alias("__to")))).alias("e"))
        .select(*scope, "e.*").distinct())
    labels = held = settle(nodes.select(*scope, node).distinct().withColumn(out, F.col(node)))
    while True:
        offered = (
            both.join(labels.withColumnRenamed(node, "__to"), [*scope, "__to"])
            .groupBy(*scope, node).agg(F.min(out).alias("__offer"))
        )
        lowered = settle(labels.join(offered, [*scope, node], "left").select(
            *scope, node, F.col(out).alias("__old"), F.least(out, F.coalesce("__offer", out)).alias("__new")))
        parents = lowered.select(*scope, F.col(node).alias("__new"), F.col("__new").alias("__up"))
        jumped = settle(lowered.join(parents, [*scope, "__new"]).select(
            *scope, node, F.col("__up").alias(out), (F.col("__up") != F.col("__old")).alias("__moved")))
        labels = jumped.select(*scope, node, out)
        release(held)
        release(lowered)
        held = jumped
        if jumped.where("__moved").limit(1).count() == 0:
            release(both)
            return labels


def follow_chain(pointers: DataFrame, starts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Nodes reached from each start along next-pointers, by pointer doubling.

    `pointers` has scope + (node, nxt), `starts` has scope + (node). The jump length doubles each round, so a chain of
    n nodes takes log2(n) rounds whatever its document holds. Pointers must not lead back.
    """
    scope = list(scope)
    reached = settle(starts.select(*scope, "node"))
    jump = settle(pointers.where("nxt is not null").select(*scope, "node", "nxt"))
    while True:
        # a jump leads past all nodes reached so far, so nothing is reached twice
        grown = settle(reached.unionByName(reached.join(jump, [*scope, "node"]).select(*scope, F.col("nxt").alias("node"))))
        further = jump.withColumnsRenamed({"node": "__from", "nxt": "node"})
        longer = settle(further.join(jump, [*scope, "node"]).select(*scope, F.col("__from").alias("node"), "nxt"))
        release(reached)
        release(jump)
        jump, reached = longer, grown
        if jump.limit(1).count() == 0:
            release(jump)
            return reached
