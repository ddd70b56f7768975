"""Search in a concept graph (survey ids QRY, VIZ-02, VIZ-03, ALG-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions.persist import cut, sent
from thicket.functions.text import contains_term
from thicket.operators.build import Graph
from thicket.schema import PROXIMITY

MOST_CONCEPTS, MOST_DEPTH = 20, 10
#: Seeds whose bits one number holds.
WORD = 62


def both_ways(edges: DataFrame) -> DataFrame:
    """(n, m, relation, weight): every edge in both directions."""
    way = lambda n, m: F.struct(F.col(n).alias("n"), F.col(m).alias("m"))
    both = F.explode(F.array(way("source", "target"), way("target", "source")))
    return edges.select(both.alias("e"), "relation", "weight").select("e.n", "e.m", "relation", "weight")


def gathered(rows: DataFrame) -> DataFrame:
    """(concept, related: array<struct<related, edge>>) of rows (concept, related, edge), in order: an answer for the eye.
    A concept's row is as long as its neighbourhood; the rows themselves are what to work on."""
    return rows.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("related", "edge"))).alias("related")).orderBy("concept")


def search_rows(graph: Graph, term: str, limit: int = MOST_CONCEPTS) -> DataFrame:
    """QRY-01: (concept, related, edge): neighbours of the concepts whose label, or an edge of theirs, contains the term.
    The first limit concepts by label."""
    label = graph.nodes.select("id", "label")
    own = label.select(F.col("id").alias("n"), F.col("label").alias("concept"))
    found = both_ways(graph.edges).join(own, "n").where(contains_term("concept", term) | contains_term("relation", term))
    # The concepts are chosen before their neighbours are looked up: a hub that isn't shown is no burden.
    shown = found.select("concept").distinct().orderBy("concept").limit(limit)
    ends = found.join(F.broadcast(shown), "concept", "left_semi").join(label.select(F.col("id").alias("m"), F.col("label").alias("related")), "m")
    return ends.select("concept", "related", F.col("relation").alias("edge"))


def search(graph: Graph, term: str, limit: int = MOST_CONCEPTS) -> DataFrame:
    """QRY-01: search_rows(), gathered()."""
    return gathered(search_rows(graph, term, limit))


def _place() -> list[Column]:
    """word and bits of a seed."""
    return [F.floor(F.col("seed") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(seed % {WORD} AS INT))").alias("bits")]


def reach(seeds: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """ALG-10: (node, word, bits): the nodes within steps edges, whatever their direction, of seeds (node, seed: numbers
    from 0). Bit seed % WORD of word seed // WORD is set in the rows of the nodes that a seed reaches.

    All seeds walk together: what a round carries on is one row a node that got a bit, whatever the number of seeds.
    """
    fresh = cut(seeds.select("node", *_place()).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "reach")
    found = [fresh]
    step = cut(both_ways(edges).select("n", "m").where("n <> m").distinct(), "steps") if steps > 0 else None
    for _ in range(steps):
        new = sent(fresh).join(step, F.col("node") == F.col("n")).groupBy(F.col("m").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        new = cut(new, "met")
        # Of the nodes met, what has been known of them; the other nodes' rows stay where they are.
        known = reduce(DataFrame.unionByName, found).join(sent(new.select("node", "word")), ["node", "word"], "left_semi").groupBy("node", "word").agg(F.bit_or("bits").alias("known"))
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        fresh = cut(new.join(known, ["node", "word"], "left").select("node", "word", left.alias("bits")).where("bits <> 0"), "reach")
        if not fresh.limit(1).count():
            break
        found.append(fresh)
    return reduce(DataFrame.unionByName, found).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def search_depth_rows(graph: Graph, term: str, depth: int, limit: int = MOST_CONCEPTS) -> DataFrame:
    """QRY-02: (concept, related, edge): for the first limit concepts, by label, whose label contains the term and that
    have an edge, the distinct (related, edge) of the edges on trails of up to depth edges (1 to 10), related being the
    label of the edge's target.

    An edge is on such a trail if an end of it is within depth - 1 steps, so trails aren't listed. The concepts are chosen
    before anything is walked, so a term that every label holds costs no more than one that few do.
    """
    depth = min(max(depth, 1), MOST_DEPTH)
    label = graph.nodes.select("id", "label")
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    named = label.where(contains_term("label", term)).join(ends, "id", "left_semi")
    shown = named.select("label").distinct().orderBy("label").limit(limit)
    # Some limit rows, or more where tenants share labels: numbering them is one small task.
    seeds = cut(named.join(F.broadcast(shown), "label", "left_semi").select(F.col("id").alias("node"), F.col("label").alias("concept"), (F.row_number().over(Window.orderBy("label", "id")) - 1).alias("seed")), "seeds")
    near = reach(seeds, graph.edges, depth - 1)
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("node"), "target", "relation")
    touched = near.join(ends, "node").groupBy("target", "relation", "word").agg(F.bit_or("bits").alias("bits"))
    related = touched.join(label.select(F.col("id").alias("target"), F.col("label").alias("related")), "target")
    own = seeds.select("concept", *_place()).withColumnRenamed("bits", "bit")
    rows = related.join(F.broadcast(own), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return rows.select("concept", "related", F.col("relation").alias("edge")).distinct()


def search_depth(graph: Graph, term: str, depth: int, limit: int = MOST_CONCEPTS) -> DataFrame:
    """QRY-02: search_depth_rows(), gathered()."""
    return gathered(search_depth_rows(graph, term, depth, limit))


def neighbours(graph: Graph, node: str) -> DataFrame:
    """VIZ-03: (related, entity_type, relation, is_proximity) around a node, explicit relations first."""
    around = both_ways(graph.edges.where((F.col("source") == node) | (F.col("target") == node))).where(F.col("n") == node)
    out = around.join(graph.nodes.select(F.col("id").alias("m"), F.col("label").alias("related"), F.coalesce("entity_type", F.lit("concept")).alias("entity_type")), "m")
    return out.select("related", "entity_type", "relation", (F.col("relation") == PROXIMITY).alias("is_proximity")).orderBy("is_proximity", "related", "relation")


def filter_labels(graph: Graph, term: str = "", hidden_types: tuple[str, ...] = ()) -> DataFrame:
    """VIZ-02: nodes whose label contains the term and whose type isn't hidden."""
    kind = F.coalesce("entity_type", F.lit("concept"))
    return graph.nodes.where(contains_term("label", term) & (~kind.isin(*hidden_types) if hidden_types else F.lit(True)))


class GraphSession:
    """QRY-03, QRY-04: a graph's tables for SQL. What other systems ask in a graph query language is asked here with
    the views nodes and edges, or with match(); Spark's own parser and optimizer do the rest."""

    def __init__(self, spark: SparkSession, graph: Graph, tenant: str | None = None):
        keep = lambda df: df if tenant is None else df.where(F.col("tenant") == tenant)
        self.spark, self.graph = spark, Graph(keep(graph.nodes), keep(graph.edges))

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over {nodes} and {edges}."""
        return self.spark.sql(query, nodes=self.graph.nodes, edges=self.graph.edges)

    def match(self, directed: bool = True) -> DataFrame:
        """(n_*, r_*, m_*): the pattern (n)-[r]->(m), or (n)-[r]-(m): both ends' and the edge's columns."""
        e = self.graph.edges if directed else both_ways(self.graph.edges).withColumnsRenamed({"n": "source", "m": "target"})
        side = lambda p: self.graph.nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in self.graph.nodes.columns])
        rel = e.select(*[F.col(c).alias(f"r_{c}") for c in e.columns])
        return rel.join(side("n"), F.col("r_source") == F.col("n_id")).join(side("m"), F.col("r_target") == F.col("m_id"))

    def json(self, rows: DataFrame) -> DataFrame:
        """Rows as JSON text, with all their columns."""
        return rows.select(F.to_json(F.struct("*")).alias("json"))
