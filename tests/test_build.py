import pytest

from thicket.operators.build import build_graph, normalised, rebuilt
from thicket.schema import PROXIMITY

DDL = "node_1 string, node_1_type string, node_2 string, node_2_type string, edge string, chunk_id string, seq long"


def triples(spark, rows):
    full = [(r[0], r[3] if len(r) > 3 else None, r[1], r[4] if len(r) > 4 else None, "knows" if len(r) < 6 else r[5], r[2], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DDL)


def edges_of(graph):
    return {(e.source, e.target): (e.relation, e.weight) for e in graph.edges.collect()}


def test_basic(spark):
    assert build_graph(triples(spark, [("Alice", "Bob", "c1"), ("Bob", "Charlie", "c1")]), proximity=False).counts() == (3, 2)


@pytest.mark.parametrize("pair", [("Rust", "RUST"), ("same", "same"), ("", "x"), ("x", " \t"), (None, "x")])
def test_loops_and_empty_ends(spark, pair):
    assert build_graph(triples(spark, [(*pair, "c")])).counts() == (0, 0)


def test_weights_add_up_both_ways(spark):
    assert edges_of(build_graph(triples(spark, [("a", "b", "c1"), (" B ", "A", "c2")]), proximity=False)) == {("a", "b"): ("knows", 8.0)}


def test_proximity(spark):
    g = build_graph(triples(spark, [("c1", "c2", "k"), ("c1", "c3", "k")]))
    assert edges_of(g) == {("c1", "c2"): ("knows", 5.0), ("c1", "c3"): ("knows", 5.0), ("c2", "c3"): (PROXIMITY, 1.0)}
    assert build_graph(triples(spark, [("a", "b", "k1"), ("c", "d", "k2")])).counts() == (4, 2)
    assert build_graph(triples(spark, [("a", "b", "k1"), ("c", "d", "k2")]), proximity_scope="run").counts() == (4, 6)
    assert build_graph(triples(spark, [("c1", "c2", "k"), ("c1", "c3", "k")]), max_nodes_per_chunk=2).counts() == (3, 2)


@pytest.mark.parametrize("size", [1, 3, 256])
def test_large_chunks_are_paired_in_blocks(spark, monkeypatch, size):
    from itertools import combinations

    from thicket.operators import build

    monkeypatch.setattr(build, "CHUNK_NODES", size)
    rows = [(f"n{i}", f"n{i * 7 % 20}", chunk) for chunk, n in (("big", 20), ("small", 3), ("one", 1), (None, 4)) for i in range(n)]
    members: dict = {}
    for a, b, c in rows:
        if c is not None and a != b:
            members.setdefault(c, set()).update((a, b))
    want = sorted((a, b, c) for c, m in members.items() for a, b in combinations(sorted(m), 2))
    assert sorted(map(tuple, build.shared_chunks(normalised(triples(spark, rows))).collect())) == want


def test_labels_types_chunks_degrees(spark):
    rows = [("a", "b", "k1", "X", None, PROXIMITY), ("a", "b", "k2", " Thing ", "", "first"), ("b", "a", "k2", None, None, "second"), ("hub", "s1", "k3"), ("hub", "s2", "k4"), ("hub", "s3", "k5")]
    g = build_graph(triples(spark, rows), proximity=False, tenant="t", communities="async")
    n = {r.id: r for r in g.nodes.collect()}
    assert (n["a"].entity_type, n["b"].entity_type, n["hub"].degree, n["a"].tenant) == ("thing", None, 3, "t")
    e = {(r.source, r.target): r for r in g.edges.collect()}
    assert e["a", "b"].relation == "first" and {tuple(r) for r in g.chunks.collect() if r.source == "a"} == {("a", "b", "k1", "t"), ("a", "b", "k2", "t")} and n["a"].community == n["b"].community != n["hub"].community


def test_a_pair_in_very_many_chunks_is_many_small_rows(spark):
    rows = [("a", "b", f"k{i}") for i in range(20_000)] + [("a", "c", "k1"), ("a", "c", None)]
    g = build_graph(triples(spark, rows))
    assert {(r.source, r.target): r.weight for r in g.edges.collect()} == {("a", "b"): 100_000.0, ("a", "c"): 9.0, ("b", "c"): 1.0}
    assert {r.source + r.target: r["count"] for r in g.chunks.groupBy("source", "target").count().collect()} == {"ab": 20_000, "ac": 1, "bc": 1}
    assert not any("array" in kind for _, kind in g.edges.dtypes + g.chunks.dtypes) and build_graph(triples(spark, rows), keep_chunks=False).chunks is None


def test_isolated_nodes(spark):
    g = build_graph(triples(spark, [("a", "b", "k")]), isolated=spark.createDataFrame([("Lone",), (" ",), ("A",)], "label string"))
    assert {r.id: r.degree for r in g.nodes.collect()} == {"a": 1, "b": 1, "lone": 0}


def test_chain(spark):
    assert build_graph(triples(spark, [(f"node_{i}", f"node_{i + 1}", f"k{i}") for i in range(100)])).counts() == (101, 100)


def test_rebuilt(spark):
    g = build_graph(triples(spark, [("a", "b", "k1"), ("a", "b", "k2")]))
    assert edges_of(rebuilt(g)) == {("a", "b"): ("knows", 4.0)} and edges_of(rebuilt(g, "stored")) == {("a", "b"): ("knows", 10.0)}


def test_empty(spark):
    t = triples(spark, [("a", "b", "k")]).limit(0)
    assert normalised(t).count() == 0 and build_graph(t, communities="async").counts() == (0, 0)


def test_a_run_without_its_list_of_pairs(spark, monkeypatch):
    """Against the graph that lists them."""
    from thicket.operators import algorithms, complete

    monkeypatch.setattr(complete, "BLOCK", 3)
    rows = [("d", "b", "k1"), ("a", "d", "k2"), ("D", "b", "k3"), ("e", "c", "k1"), ("f", "a", "k9"), ("f", "g", "k9"), ("h", "h", "k1")]
    listed, g = build_graph(triples(spark, rows), proximity_scope="run", keep_chunks=False), complete.run_graph(triples(spark, rows))
    pairs = {(r.source, r.target): (r.relation, r.weight) for r in listed.edges.collect()}
    assert len(pairs) == 21 and {r.id: r.degree for r in complete.degrees(g).collect()} == {r.id: r.degree for r in listed.nodes.collect()}
    got = complete.weights(g, listed.edges.select("source", "target")).collect()
    assert {(r.source, r.target): (r.relation or PROXIMITY, r.weight) for r in got} == pairs
    want = algorithms.basic_stats(listed.nodes, listed.edges).first().asDict() | {"n_components": 1}
    assert complete.stats(g).first().asDict() == want and {r.component for r in complete.components(g).collect()} == {"a"}
    value = lambda df: {r[0]: r[1] for r in df.collect()}
    assert value(complete.pagerank(g)) == pytest.approx(value(algorithms.pagerank(listed.nodes, listed.edges)))
    assert value(complete.path_costs(g, "B")) == pytest.approx(value(algorithms.path_costs(listed.nodes, listed.edges, "b"))) and complete.path_costs(g, "none").count() == 0
    none = complete.run_graph(triples(spark, rows).limit(0))
    assert complete.pagerank(none).count() == complete.degrees(none).count() == 0 and complete.stats(none).first().n_edges == 0
