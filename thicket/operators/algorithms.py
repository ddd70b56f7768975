"""Iterative graph algorithms (survey ids ALG). Loops write their state to the shared folder, so a lost executor costs
a round at most and plans stay short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.persist import cut, cut_and_told, sent
from thicket.operators.build import Graph
from thicket.operators.search import both_ways


def pagerank(nodes: DataFrame | None, edges: DataFrame, damping: float = 0.85, iterations: int = 30, directed: str = "lexicographic") -> DataFrame:
    """ALG-01: (id, rank). A fixed number of rounds from 1/n each; what nodes without outgoing edges hold is spread
    over all nodes. Edges count once each, unweighted, from source to target ('both' for both ways). nodes: those with and
    without edges; None for the ends of the edges.

    Links are dealt by their source once; each round moves the ranks only. A round's ranks are written, so a lost executor
    costs a round.
    """
    own = edges.select("source", "target")  # a graph may be a long plan; it is worked out once
    pairs = cut(own if directed == "lexicographic" else both_ways(edges).select(F.col("n").alias("source"), F.col("m").alias("target")), "pairs")
    ids = pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct() if nodes is None else nodes.select("id")
    out = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    ranks = cut(ids.join(out.select(F.col("source").alias("id"), "out"), "id", "left"), "ranks")
    n = ranks.count()
    if not n:
        return ranks.select("id", F.lit(0.0).alias("rank"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = pairs.repartition(tasks, "source").persist()
    ranks = ranks.select("id", F.lit(1.0 / n).alias("rank"), "out")
    # What nodes without outgoing edges hold; of each round it is summed as the ranks are written.
    held = F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("lost")
    lost = ranks.agg(held).first()[0] or 0.0
    for _ in range(iterations):
        given = ranks.where("out is not null").select(F.col("id").alias("source"), (F.col("rank") / F.col("out")).alias("share")).join(links, "source")
        both = given.select(F.col("target").alias("id"), "share").unionByName(ranks.select("id", "out"), allowMissingColumns=True)
        got = both.groupBy("id").agg(F.sum("share").alias("share"), F.max("out").alias("out"))
        ranks = got.select("id", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("share", F.lit(0.0))).alias("rank"), "out")
        ranks, told = cut_and_told(ranks, "ranks", held)
        lost = told["lost"] or 0.0
    links.unpersist()
    return ranks.select("id", "rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ALG-04: (id, component): the smallest id that is reachable, whatever the edges' direction.

    Rounds of large-star and small-star: each hangs neighbours on the smallest one known, until only stars are left.
    """
    # A digest of the stars, taken as they are written, tells whether a round changed anything.
    state = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    e, seen = cut_and_told(edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct(), "stars", *state)
    while seen["n"]:
        least = e.union(e.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.union(e.select("v", "u")).where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        e, now = cut_and_told(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "stars", *state)
        if now == seen:
            break
        seen = now
    up = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select("id").join(up, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def undirected(edges: DataFrame) -> DataFrame:
    """(n, m, w): both ways, a pair's weights added up, loops left out."""
    pair = edges.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"))
    return both_ways(pair.withColumn("relation", F.lit(""))).select("n", "m", F.col("weight").alias("w"))


#: Logs of costs are put together when there are so many.
MOST_LOGS = 12


def _steps(edges: DataFrame) -> DataFrame:
    """(n, m, c): both ways, what it costs to go from n to m: 1 / max(weight, 0.001)."""
    return undirected(edges).select("n", "m", (1.0 / F.greatest("w", F.lit(0.001))).alias("c"))


def path_costs(nodes: DataFrame, edges: DataFrame, start: str, width: float | None = None, until: str | None = None, steps: DataFrame | None = None) -> DataFrame:
    """ALG-03: (id, cost) of the nodes that start reaches. start is found whatever its case; of until, too, if it is given:
    then the walk ends when its cost is settled, and dearer nodes may be missing or too dear. steps is _steps(edges), where
    that is at hand.

    Costs are settled in buckets of this width (by default twice the mean cost of a step): nodes of the bucket at hand are
    relaxed until it gets no new ones, the others wait. A round moves the nodes that got cheaper and their neighbours; what
    is known is a log of costs, of which only the rows of nodes just met are looked up.
    """
    steps = cut(_steps(edges), "steps") if steps is None else steps
    if width is None:
        width = 2 * (steps.agg(F.avg("c")).first()[0] or 1.0)
    first = cut(nodes.where(F.lower("id") == start.lower()).select("id", F.lit(0.0).alias("cost")), "costs")
    log, waiting, end = [first], [], width
    frontier = first
    goal = until.lower() if until is not None else None

    def known(rows: DataFrame) -> DataFrame:
        """(id, known): the least costs so far of the nodes in rows."""
        return reduce(DataFrame.unionByName, log).join(sent(rows.select("id")), "id", "left_semi").groupBy("id").agg(F.min("cost").alias("known"))

    while True:
        while frontier is not None:
            met = sent(frontier).join(steps, F.col("id") == F.col("n")).groupBy(F.col("m").alias("id")).agg(F.min(F.col("cost") + F.col("c")).alias("cost"))
            met = cut(met, "met")
            cheaper = met.join(known(met), "id", "left").where("known IS NULL OR cost < known").select("id", "cost")
            cheaper, told = cut_and_told(cheaper, "costs", F.count_if(F.col("cost") < end).alias("near"), F.count_if(F.col("cost") >= end).alias("far"))
            near, far = told["near"], told["far"]
            if near or far:
                log.append(cheaper)
            if far:
                waiting.append(cheaper.where(F.col("cost") >= end))
            frontier = cheaper.where(F.col("cost") < end) if near else None
            if len(log) >= MOST_LOGS:
                log = [cut(reduce(DataFrame.unionByName, log).groupBy("id").agg(F.min("cost").alias("cost")), "costs")]
        if goal is not None and reduce(DataFrame.unionByName, log).where(F.lower("id") == goal).where(F.col("cost") < end).limit(1).count():
            break
        while waiting and frontier is None:  # the next bucket that has a node whose cost still holds
            late = reduce(DataFrame.unionByName, waiting).where(F.col("cost") >= end)
            least = late.agg(F.min("cost")).first()[0]
            if least is None:
                waiting = []
                break
            end = (least // width + 1) * width
            end = end if end > least else end + width
            late = cut(late, "late")
            ready = cut(late.where(F.col("cost") < end), "ready")
            ready = cut(ready.join(known(ready), "id").where("cost = known").select("id", "cost").distinct(), "ready")
            waiting = [late.where(F.col("cost") >= end)]
            frontier = ready if ready.limit(1).count() else None
        if frontier is None:
            break
    return reduce(DataFrame.unionByName, log).groupBy("id").agg(F.min("cost").alias("cost"))


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """ALG-03: (step int, id, cost): the cheapest path from start to end; no rows if there is none. Of equally cheap
    predecessors the one nearer to the start goes, then the one that sorts first.

    The way back looks at one node's neighbours at a time; what comes to the driver is the path.
    """
    spark = nodes.sparkSession
    steps = cut(_steps(edges), "steps")
    costs = cut(path_costs(nodes, edges, start, until=end, steps=steps), "costs")
    here = costs.where(F.lower("id") == end.lower()).orderBy("id").first()
    path = [here] if here else []
    while here and here["cost"] > 0:
        before = steps.where(F.col("m") == here["id"]).select(F.col("n").alias("id"), "c").join(costs, "id")
        before = before.where((F.abs(F.col("cost") + F.col("c") - here["cost"]) < 1e-6) & (F.col("cost") < here["cost"]))
        here = before.select("id", "cost").orderBy("cost", "id").first()
        path.append(here)
    rows = [(i, r["id"], r["cost"]) for i, r in enumerate(reversed([r for r in path if r]))]
    return spark.createDataFrame(rows, "step int, id string, cost double")


def annotated(path: DataFrame, edges: DataFrame) -> DataFrame:
    """QRY-06: (step, from, to, relation) of a path's hops; the first relation by name of the pair's edges, else 'related'."""
    hop = path.select("step", F.lower("id").alias("a")).join(path.select((F.col("step") - 1).alias("step"), F.lower("id").alias("b")), "step")
    pair = edges.select(F.lower(F.least("source", "target")).alias("lo"), F.lower(F.greatest("source", "target")).alias("hi"), "relation").groupBy("lo", "hi").agg(F.min("relation").alias("relation"))
    out = hop.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(pair, ["lo", "hi"], "left")
    return out.select("step", F.col("a").alias("from"), F.col("b").alias("to"), F.coalesce("relation", F.lit("related")).alias("relation"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """ALG-08: (entity_type, n), most frequent first; null counts as 'untyped'."""
    return nodes.groupBy(F.coalesce("entity_type", F.lit("untyped")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type")


def top_degrees(degree: DataFrame, k: int = 10) -> DataFrame:
    return degree.orderBy(F.desc("degree"), "id").limit(k)


def basic_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ALG-07 without what loops: one row of n_nodes, n_edges, density (of directed pairs), avg_degree and max_degree."""
    from thicket.operators.build import degrees

    d = degrees(nodes, edges)
    one = d.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("degree") / 2, F.lit(0)).cast("long").alias("n_edges"), F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return one.select("n_nodes", "n_edges", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * m / n).otherwise(0.0).alias("avg_degree"), "max_degree")


def graph_stats(graph: Graph, k: int = 10, parts: tuple[str, ...] = ("summary", "top_degree", "top_pagerank")) -> dict[str, DataFrame]:
    """ALG-07: of 'summary' (one row), 'top_degree' and 'top_pagerank' (k rows each), the parts asked for."""
    from thicket.operators.build import degrees
    from thicket.operators.communities import label_propagation

    graph = Graph(cut(graph.nodes, "nodes"), cut(graph.edges, "edges"))
    out = {}
    if "summary" in parts:
        basic = basic_stats(graph.nodes, graph.edges)
        comps = components(graph.nodes, graph.edges).agg(F.count_distinct("component").alias("n_components"))
        comms = label_propagation(graph.nodes, graph.edges).agg(F.count_distinct("community").alias("n_communities"))
        out["summary"] = basic.crossJoin(F.broadcast(comps)).crossJoin(F.broadcast(comms))  # a row each
    if "top_degree" in parts:
        out["top_degree"] = top_degrees(degrees(graph.nodes, graph.edges), k)
    if "top_pagerank" in parts:
        out["top_pagerank"] = pagerank(graph.nodes, graph.edges).orderBy(F.desc("rank"), "id").limit(k)
    return out
