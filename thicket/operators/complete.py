"""Graphs of one run (survey id BLD-07, scope 'run'): every pair of nodes is near, so nearness isn't listed.

With all triples taken as of one chunk, a graph of n nodes has n (n - 1) / 2 edges. What is kept of it is its nodes and
its explicit edges; that every pair has an edge, which weighs at least 1, is in the formulas here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.persist import cut, numbered
from thicket.operators.algorithms import path_costs as listed_costs
from thicket.operators.build import SHARED_WEIGHT, edges, nodes, normalised

#: Nodes whose ranks are added up in a row; of each so many the sum alone goes on.
BLOCK = 50_000


@dataclass
class CompleteGraph:
    """nodes (id, label, entity_type) and explicit edges (source, target, relation, weight), nearness included in their
    weights; all other pairs of nodes have an edge of weight SHARED_WEIGHT, which is near and nothing else."""

    nodes: DataFrame
    edges: DataFrame


def run_graph(triples: DataFrame) -> CompleteGraph:
    """The graph that build_graph(proximity_scope='run') lists. Nodes without a triple are near to none, so they aren't
    of it."""
    rows = cut(normalised(triples), "triples")
    own = cut(nodes(rows), "nodes")
    return CompleteGraph(own, cut(edges(rows, proximity=False).withColumn("weight", F.col("weight") + SHARED_WEIGHT), "edges"))


def degrees(graph: CompleteGraph) -> DataFrame:
    """BLD-09: (id, degree): all others."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))  # one row
    return graph.nodes.select("id").crossJoin(F.broadcast(n)).select("id", (F.col("n") - 1).alias("degree"))


def stats(graph: CompleteGraph) -> DataFrame:
    """ALG-07: one row of n_nodes, n_edges, density (of directed pairs), avg_degree, max_degree and n_components."""
    n = F.col("n_nodes")
    one = graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    return one.select(
        "n_nodes", (n * (n - 1) / 2).cast("long").alias("n_edges"), F.when(n > 1, 0.5).otherwise(0.0).alias("density"), F.greatest(n - 1, F.lit(0)).cast("double").alias("avg_degree"),
        F.greatest(n - 1, F.lit(0)).alias("max_degree"), F.least(n, F.lit(1)).cast("long").alias("n_components"),
    )


def components(graph: CompleteGraph) -> DataFrame:
    """ALG-04: (id, component): the smallest id of all."""
    return graph.nodes.select("id").crossJoin(F.broadcast(graph.nodes.agg(F.min("id").alias("component"))))


def weights(graph: CompleteGraph, pairs: DataFrame) -> DataFrame:
    """pairs (source, target, in order) with relation (null for nearness alone) and weight."""
    found = pairs.join(graph.edges, ["source", "target"], "left")
    return found.select("source", "target", "relation", F.coalesce("weight", F.lit(SHARED_WEIGHT)).alias("weight"))


def path_costs(graph: CompleteGraph, start: str) -> DataFrame:
    """ALG-03: (id, cost). A step between two nodes that are only near costs 1, so no path costs more than the direct step,
    and none that is cheaper has such a step in it."""
    far = graph.nodes.select("id", F.when(F.lower("id") == start.lower(), 0.0).otherwise(1.0 / SHARED_WEIGHT).alias("direct"))
    near = listed_costs(graph.nodes, graph.edges, start)
    there = graph.nodes.where(F.lower("id") == start.lower()).limit(1).count()
    rows = far.join(near, "id", "left").select("id", F.least("direct", "cost").alias("cost"))
    return rows if there else rows.limit(0)


def pagerank(graph: CompleteGraph, damping: float = 0.85, iterations: int = 30) -> DataFrame:
    """ALG-01: (id, rank), from the smaller to the greater id of every pair. The node at place i of n gets from each node
    before it the (n - 1 - j)-th part of its rank, j being that one's place: a running sum over the nodes in order, taken in
    blocks; of other blocks only their sums matter."""
    own = cut(numbered(graph.nodes.select("id"), "i", "id"), "places")
    n = own.count()
    if not n:
        return own.select("id", F.lit(0.0).alias("rank"))
    ranks = own.select("id", "i", F.floor(F.col("i") / BLOCK).alias("block"), F.lit(1.0 / n).alias("rank"))
    share = F.when(F.col("i") < n - 1, F.col("rank") / (n - 1 - F.col("i"))).otherwise(0.0)
    before = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(iterations):
        blocks = ranks.groupBy("block").agg(F.sum(share).alias("sum"), F.max(F.when(F.col("i") == n - 1, F.col("rank"))).alias("lost"))
        blocks = cut(blocks, "blocks")  # a row for each block
        lost = blocks.agg(F.max("lost")).first()[0]
        ahead = blocks.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("ahead"))
        got = F.coalesce(F.sum(share).over(before), F.lit(0.0)) + F.col("ahead")
        ranks = cut(ranks.join(F.broadcast(ahead), "block").select("id", "i", "block", (F.lit((1 - damping) / n + damping * lost / n) + damping * got).alias("rank")), "ranks")
    return ranks.select("id", "rank")
