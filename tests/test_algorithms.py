import random

import pytest

from thicket.operators import algorithms as A
from thicket.operators import communities as C
from thicket.operators.build import Graph


def graph(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(extra))
    return Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "r", float(w)) for a, b, w in edges], "source string, target string, relation string, weight double"))


def labels(df):
    return {r.id: r.community for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, [("a", "b", 4), ("b", "c", 4), ("a", "c", 2)])


def test_pagerank(spark, small):
    r = {x.id: x.rank for x in A.pagerank(small.nodes, small.edges).collect()}
    assert r == pytest.approx({"a": 0.197580, "b": 0.281551, "c": 0.520869}, abs=1e-6) and sum(r.values()) == pytest.approx(1)
    both = {x.id: x.rank for x in A.pagerank(small.nodes, small.edges, directed="both").collect()}
    assert both == pytest.approx(dict.fromkeys("abc", 1 / 3))
    assert A.pagerank(small.nodes.limit(0), small.edges).count() == 0


def test_paths(spark, small):
    path = lambda a, b: [(r.step, r.id, r.cost) for r in sorted(A.shortest_path(small.nodes, small.edges, a, b).collect())]
    assert path("A", "C") == [(0, "a", 0.0), (1, "c", 0.5)]
    assert path("a", "a") == [(0, "a", 0.0)] and path("a", "nowhere") == [] == path("nowhere", "a")
    two = graph(spark, [], ["x", "y"])
    assert A.shortest_path(two.nodes, two.edges, "x", "y").count() == 0
    hops = A.annotated(A.shortest_path(small.nodes, small.edges, "a", "b"), small.edges).collect()
    assert [(h["from"], h["to"], h["relation"]) for h in hops] == [("a", "b", "r")]


def test_costs_against_dijkstra(spark):
    import heapq

    rng = random.Random(5)
    edges = list({(a, b): (a, b, rng.choice([0.5, 1, 2, 4, 8])) for a, b in (sorted(rng.sample([f"n{i:02d}" for i in range(40)], 2)) for _ in range(70))}.values())
    g = graph(spark, edges, ["n00"])
    around: dict = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, 1 / w))
        around.setdefault(b, []).append((a, 1 / w))
    cost, heap = {}, [(0.0, "n00")]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in cost:
            cost[n] = c
            for m, w in around.get(n, []):
                heapq.heappush(heap, (c + w, m))
    for width in (None, 0.3, 100.0):
        assert {r.id: r.cost for r in A.path_costs(g.nodes, g.edges, "N00", width).collect()} == pytest.approx(cost)
    far = max(cost, key=lambda i: (cost[i], i))
    path = sorted((r.step, r.id, r.cost) for r in A.shortest_path(g.nodes, g.edges, "n00", far.upper()).collect())
    assert path[0][1:] == ("n00", 0.0) and path[-1][1] == far and path[-1][2] == pytest.approx(cost[far])
    assert all(min(w for m, w in around[a] if m == b) == pytest.approx(d - c) for (_, a, c), (_, b, d) in zip(path, path[1:]))


def test_costs_along_a_chain_move_the_frontier_only(spark, monkeypatch):
    """Rounds are as many as buckets ask for, and none joins more than the nodes just met and what is known of them."""
    n = 40
    g = graph(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 1 + i % 3) for i in range(n)])
    written = []
    cut = A.cut
    monkeypatch.setattr(A, "cut", lambda df, label="cut": (lambda out: written.append((label, out.count())) or out)(cut(df, label)))
    got = {r.id: r.cost for r in A.path_costs(g.nodes, g.edges, "n000").collect()}
    assert len(got) == n + 1 and got["n003"] == pytest.approx(1 + 1 / 2 + 1 / 3)
    assert all(k <= 4 for label, k in written if label == "met")


def test_components_and_stats(spark):
    g = graph(spark, [("a", "b", 1), ("c", "d", 1), ("d", "e", 1)], ["z"])
    assert {r.id: r.component for r in A.components(g.nodes, g.edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "z": "z"}
    s = A.graph_stats(g)
    row = s["summary"].first()
    assert (row.n_nodes, row.n_edges, row.n_components, row.max_degree) == (6, 3, 3, 2) and row.density == 3 / 30 and row.avg_degree == 1.0
    assert [r.id for r in s["top_degree"].collect()][:1] == ["d"] and s["top_pagerank"].count() == 6
    chain = graph(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(120)])
    assert {r.component for r in A.components(chain.nodes, chain.edges).collect()} == {"n000"}


@pytest.mark.parametrize("mode", ["async", "sync"])
def test_communities(spark, mode):
    g = graph(spark, [("a", "b", 4), ("b", "c", 4), ("a", "c", 4), ("x", "y", 4), ("y", "z", 4), ("x", "z", 4)], ["lone"])
    got = labels(C.label_propagation(g.nodes, g.edges, mode=mode))
    assert got["a"] == got["b"] == got["c"] == 0 and got["x"] == got["y"] == got["z"] and sorted(set(got.values())) == [0, 1, 2] and got["lone"] == 1
    top = C.summary(C.label_propagation(g.nodes, g.edges, mode=mode)).collect()
    assert [r["size"] for r in top] == [3] * 6 + [1] and [r["id"] for r in top] == list("abcxyz") + ["lone"]
    assert {len(r.members) for r in C.first_members(C.label_propagation(g.nodes, g.edges), 2).collect()} == {1, 2}


def test_weak_bridge(spark):
    g = graph(spark, [("a", "b", 10), ("b", "c", 10), ("a", "c", 10), ("d", "e", 10), ("e", "f", 10), ("d", "f", 10), ("c", "d", 0.1)])
    got = labels(C.label_propagation(g.nodes, g.edges))
    assert got["a"] == got["b"] == got["c"] and got["d"] == got["e"] == got["f"]


def settled(ids, edges, rounds=50):
    """The rule of 'async' mode in plain Python: in each round, of the nodes that ask for a change, those move that come
    before all neighbours that ask for one."""
    from hashlib import md5

    around = {i: {} for i in ids}
    for a, b, w in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0) + w
            around[b][a] = around[b].get(a, 0) + w
    order = {i: md5(i.encode()).hexdigest() for i in ids}
    tag = {i: i for i in ids}
    for k in range(rounds):
        asks = {}
        for i in ids:
            votes = {}
            for j, w in around[i].items():
                votes[tag[j]] = votes.get(tag[j], 0) + w
            if votes and (best := min(votes, key=lambda t: (-votes[t], t))) != tag[i]:
                asks[i] = best
        if not asks:
            return tag, k
        for i, best in [(i, b) for i, b in asks.items() if all(j not in asks or order[i] < order[j] for j in around[i])]:
            tag[i] = best
    return tag, rounds


@pytest.mark.parametrize("shape", ["random", "chain", "bipartite"])
def test_async_communities_against_plain_python(spark, shape):
    rng = random.Random(11)
    if shape == "random":
        edges = list({(a, b): (a, b, rng.randrange(1, 5)) for a, b in (sorted(rng.sample([f"n{i:03d}" for i in range(120)], 2)) for _ in range(110))}.values())
    elif shape == "chain":
        edges = [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(40)]
    else:  # where rounds in which all move swap tags for ever
        edges = [(f"a{i}", f"b{j}", 1) for i in range(6) for j in range(6)]
    g, ids = graph(spark, edges), sorted({x for e in edges for x in e[:2]})
    (tag, used), number = settled(ids, edges), {}
    for i in ids:
        number.setdefault(tag[i], len(number))
    assert shape == "chain" or used < 50
    assert labels(C.label_propagation(g.nodes, g.edges)) == {i: number[tag[i]] for i in ids}


@pytest.mark.parametrize("rounds", [4, 5, 50, 51])
def test_sync_tags_that_come_back(spark, rounds):
    edges = [("hub", f"leaf{i}", 1) for i in range(4)]
    g, tag = graph(spark, edges), {i: i for i in ["hub", *(f"leaf{i}" for i in range(4))]}
    for _ in range(rounds):
        votes = sorted((-sum(tag[f"leaf{i}"] == t for i in range(4)), t) for t in set(tag.values()))
        tag = {"hub": votes[0][1]} | {f"leaf{i}": tag["hub"] for i in range(4)}
    assert {r.id: r.tag for r in C.propagated(g.nodes, g.edges, rounds).collect()} == tag


def test_components_of_a_deep_chain_in_shuffled_order(spark):
    rng = random.Random(2)
    names = [f"n{i:04d}" for i in rng.sample(range(3000), 400)]
    g = graph(spark, list(zip(names, names[1:], [1] * 399)))
    assert {r.component for r in A.components(g.nodes, g.edges).collect()} == {min(names)}


def one_by_one(ids, edges, rounds=50):
    """Label propagation as a single process does it: by id, each node at once takes the tag that it asks for."""
    around = {i: {} for i in ids}
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0) + w
        around[b][a] = around[b].get(a, 0) + w
    tag = {i: i for i in ids}
    for _ in range(rounds):
        moved = False
        for i in sorted(ids):
            votes = {}
            for j, w in around[i].items():
                votes[tag[j]] = votes.get(tag[j], 0) + w
            if votes and (best := min(votes, key=lambda t: (-votes[t], t))) != tag[i]:
                tag[i], moved = best, True
        if not moved:
            break
    return tag


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_communities_are_those_of_one_process(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(24)]
    edges = list({(a, b): (a, b, rng.randrange(1, 4)) for a, b in (sorted(rng.sample(ids, 2)) for _ in range(30))}.values())
    g = graph(spark, edges, ids)
    assert {r.id: r.tag for r in C.visited(g.nodes, g.edges).collect()} == one_by_one(ids, edges)
    level = {r.id: r.level for r in C.levels(C.undirected(g.edges), g.nodes).collect()}
    assert len(level) == 24 and all(level[b] > level[a] for a, b, _ in edges)
    assert C.label_propagation(g.nodes.limit(0), g.edges.limit(0), mode="ordered").count() == 0
