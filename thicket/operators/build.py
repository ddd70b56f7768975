"""From triples to a concept graph (survey ids BLD).

Triples have node_1, node_1_type, node_2, node_2_type, edge, chunk_id and seq, which puts them in an order (any type
that sorts, a struct for instance).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.persist import cut
from thicket.functions.text import norm_key
from thicket.schema import DEFAULT_TENANT, PROXIMITY

EXPLICIT_WEIGHT, SHARED_WEIGHT = 4.0, 1.0
#: Triples of a chunk whose nodes are paired in one row; larger chunks are paired in blocks of about so many nodes.
CHUNK_NODES = 256


@dataclass
class Graph:
    """BLD-11: nodes (id, label, degree, community, entity_type, tenant), edges (source, target, relation, weight, tenant),
    each pair of nodes once with source < target, and, if they were asked for, the chunks of edges (source, target,
    chunk_id, tenant), a row for each, so that no edge has a row that grows with the corpus."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame | None = None

    def counts(self) -> tuple[int, int]:
        """BLD-13."""
        return self.nodes.count(), self.edges.count()


def normalised(triples: DataFrame) -> DataFrame:
    """BLD-01, BLD-04: triples with keys a and b and their order (source, target); without those whose ends are empty
    or the same. Types are keys, too; empty ones are null."""
    kind = lambda c: F.nullif(norm_key(c), F.lit(""))
    out = triples.select(norm_key("node_1").alias("a"), norm_key("node_2").alias("b"), kind("node_1_type").alias("a_type"), kind("node_2_type").alias("b_type"), "edge", "chunk_id", "seq")
    return out.where("a <> '' and b <> '' and a <> b").withColumns({"source": F.least("a", "b"), "target": F.greatest("a", "b")})


def nodes(triples: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """BLD-02, BLD-03: (id, label, entity_type) of the ends of normalised triples; the last type that isn't empty holds.
    isolated has a column label: nodes that exist without a triple."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a_type").alias("t")), F.struct(F.col("b").alias("id"), F.col("b_type").alias("t")))).alias("e"), "seq")
    ends = ends.select("e.id", "e.t", "seq")
    if isolated is not None:
        extra = isolated.select(norm_key("label").alias("id")).where("id <> ''")
        ends = ends.unionByName(extra, allowMissingColumns=True)
    return ends.groupBy("id").agg(F.max_by("t", F.when(F.col("t").isNotNull(), F.col("seq"))).alias("entity_type")).select("id", F.col("id").alias("label"), "entity_type")


def incidence(triples: DataFrame) -> DataFrame:
    """BLD-06: the distinct (chunk_id, id) of normalised triples."""
    return triples.select("chunk_id", F.explode(F.array("a", "b")).alias("id")).distinct()


def shared_chunks(triples: DataFrame, max_nodes_per_chunk: int | None = None) -> DataFrame:
    """BLD-07: (source, target, chunk_id) for each pair of nodes and each chunk that has both.

    The pairs of a chunk are what is asked for, so a chunk of k nodes makes k * (k - 1) / 2 of them; max_nodes_per_chunk
    leaves larger chunks out (none by default). A chunk's nodes are gathered once, and paired in the row. Chunks of more
    than CHUNK_NODES rows are cut to blocks of nodes, and pairs of blocks are dealt out, so no row or task holds a large one.
    Triples without a chunk are near to none.
    """
    triples = triples.where(F.col("chunk_id").isNotNull())
    if max_nodes_per_chunk is not None:
        sizes = incidence(triples).groupBy("chunk_id").count().where(F.col("count") <= max_nodes_per_chunk)
        triples = triples.join(sizes.select("chunk_id"), "chunk_id", "left_semi")
    rows = triples.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(rows.where(F.col("n") > CHUNK_NODES).select("chunk_id", F.ceil(F.col("n") / CHUNK_NODES).cast("int").alias("blocks")), "large")
    some = bool(large.limit(1).count())
    small = triples.join(large, "chunk_id", "left_anti") if some else triples
    members = small.groupBy("chunk_id").agg(F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("b"))).alias("ids"))
    after = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("source"), y.alias("target")))
    pairs = members.where("size(ids) > 1").select("chunk_id", F.explode(F.flatten(F.transform("ids", after))).alias("p"))
    pairs = pairs.select("p.source", "p.target", "chunk_id")
    return pairs.unionByName(_large_chunks(triples.join(large, "chunk_id"))) if some else pairs


def _large_chunks(triples: DataFrame) -> DataFrame:
    """The pairs of triples (with blocks, the number of blocks of their chunk), block by block."""
    members = triples.select("chunk_id", "blocks", F.explode(F.array("a", "b")).alias("id")).distinct()
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = cut(members.groupBy("chunk_id", "blocks", block.alias("block")).agg(F.collect_list("id").alias("ids")), "blocks")
    # Each block meets every block that isn't before it; the pairs of two blocks are made where both are.
    one = held.select("chunk_id", "block", F.col("ids").alias("left"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    both = one.join(held.select("chunk_id", F.col("block").alias("other"), F.col("ids").alias("right")), ["chunk_id", "other"])
    x = both.select("chunk_id", F.col("block") == F.col("other"), F.explode("left").alias("x"), "right").toDF("chunk_id", "same", "x", "right")
    pairs = x.select("chunk_id", "same", "x", F.explode("right").alias("y")).where((~F.col("same") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "chunk_id")


def _label(edge: str = "edge") -> Column:
    """BLD-08: the first relation that isn't mere nearness; null if there is none."""
    own = F.when(F.col(edge) != PROXIMITY, F.col("seq"))
    return F.min_by(F.when(F.col(edge) != PROXIMITY, F.col(edge)), own)


def edges(triples: DataFrame, proximity: bool = True, max_nodes_per_chunk: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """BLD-05, BLD-07, BLD-08: (source, target, relation, weight): 4 for every triple, 1 for every chunk that both ends
    share. Nearness is summed apart, as only explicit rows have labels to choose from; both meet by pair. near is
    shared_chunks(), where that has been worked out already."""
    explicit = triples.groupBy("source", "target").agg(_label().alias("relation"), (F.count(F.lit(1)) * EXPLICIT_WEIGHT).alias("weight"))
    if not proximity:
        return explicit.select("source", "target", F.coalesce("relation", F.lit(PROXIMITY)).alias("relation"), "weight")
    near = shared_chunks(triples, max_nodes_per_chunk) if near is None else near
    both = explicit.join(near.groupBy("source", "target").agg((F.count(F.lit(1)) * SHARED_WEIGHT).alias("near")), ["source", "target"], "full_outer")
    weight = F.coalesce("weight", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))
    return both.select("source", "target", F.coalesce("relation", F.lit(PROXIMITY)).alias("relation"), weight.alias("weight"))


def edge_chunks(triples: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """BLD-05: (source, target, chunk_id): the chunks of each edge, a row each: those of its triples and, with near
    (shared_chunks()), those that both ends share."""
    own = triples.where(F.col("chunk_id").isNotNull()).select("source", "target", "chunk_id")
    return (own if near is None else own.unionByName(near)).distinct()


def degrees(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """BLD-09, ALG-02: (id, degree): edges that touch each node, 0 for isolated ones."""
    ends = edge_rows.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return node_rows.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def build_graph(triples: DataFrame, tenant: str = DEFAULT_TENANT, isolated: DataFrame | None = None, proximity: bool = True, proximity_scope: str = "chunk", communities: str | None = None, keep_chunks: bool = True, max_nodes_per_chunk: int | None = None) -> Graph:
    """BLD-10 to BLD-12: a graph of triples. proximity_scope 'run' takes all triples as of one chunk; communities is
    'sync', 'async' or 'ordered' (ALG-05), or None for none. Scope 'run' lists every pair of nodes; complete.run_graph() is
    the same graph without the list."""
    rows = normalised(triples)
    if proximity_scope == "run":
        rows = rows.withColumn("chunk_id", F.lit("document"))
    rows = cut(rows, "triples")  # worked out once: edges, nearness and nodes read them
    near = cut(shared_chunks(rows, max_nodes_per_chunk), "near") if proximity and keep_chunks else None
    e = cut(edges(rows, proximity, max_nodes_per_chunk, near), "edges")
    chunks = edge_chunks(rows, near).withColumn("tenant", F.lit(tenant)) if keep_chunks else None
    n = nodes(rows, isolated)
    n = n.join(degrees(n, e), "id")
    if communities:
        from thicket.operators.communities import label_propagation

        n = n.join(label_propagation(n, e, mode=communities), "id")
    else:
        n = n.withColumn("community", F.lit(None).cast("long"))
    return Graph(n.select("id", "label", "degree", "community", "entity_type", F.lit(tenant).alias("tenant")), e.withColumn("tenant", F.lit(tenant)), chunks)


def rebuilt(graph: Graph, weights: str = "uniform") -> Graph:
    """BLD-14: a graph for analytics from stored edges: one edge for each pair, of weight 4 for each stored edge
    ('uniform'), or of the sum of the stored weights ('stored'). Isolated nodes stay."""
    w = F.lit(EXPLICIT_WEIGHT) if weights == "uniform" else F.col("weight")
    pair = graph.edges.select(norm_key("source").alias("a"), norm_key("target").alias("b"), "relation", w.alias("w")).where("a <> '' and b <> '' and a <> b")
    e = pair.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.min("relation").alias("relation"), F.sum("w").alias("weight"))
    n = graph.nodes.select(norm_key("id").alias("id")).where("id <> ''").union(e.select("source")).union(e.select("target")).distinct()
    return Graph(n.withColumn("label", F.col("id")), e)
