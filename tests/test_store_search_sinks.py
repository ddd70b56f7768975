import json
import subprocess
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from thicket.cli import main
from thicket.functions.persist import numbered
from thicket.operators import sinks
from thicket.operators.build import Graph, build_graph
from thicket.operators.search import GraphSession, filter_labels, neighbours, reach, search, search_depth, search_depth_rows
from thicket.operators.selection import ledger_stats, ledger_upsert, representative, unseen
from thicket.operators.store import GraphStore, fetched, merged, stored
from thicket.schema import EDGE, LEDGER, NODE, PROXIMITY
from thicket.sources.config import expand, load_config, with_context_file
from thicket.sources.files import read_documents
from thicket.sources.relations import as_triples, manual, read_graphml, read_manual


def graph(spark, rows, tenant="default"):
    return build_graph(manual(spark, rows), tenant, proximity=False)


def sample(spark):
    nodes = [("rust", 'Ru"st', None, 3, "technology", "default"), ("tokio", "Tokio <&>", 1, None, None, "default"), ("it's", "it's", 2, 1, None, "default")]
    edges = [("rust", "tokio", 'uses "async"', 4.0, "default"), ("it's", "rust", PROXIMITY, 0.5, "default")]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


# --- store


def test_replace_and_merge(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "w"))
    assert store.load().counts() == (0, 0)
    store.replace(graph(spark, [("a", "b", "r", "T", None)]))
    store.replace(graph(spark, [("x", "y", "r")], "other"), "other")
    store.merge(graph(spark, [("a", "b", "r"), ("b", "c", "s")]))
    g = store.load("default")
    n, e = {r.id: r for r in g.nodes.collect()}, {(r.source, r.target, r.relation): r.weight for r in g.edges.collect()}
    assert {i: r.degree for i, r in n.items()} == {"a": 2, "b": 3, "c": 1} and n["a"].entity_type == "concept" and e == {("a", "b", "r"): 8.0, ("b", "c", "s"): 4.0}
    store.replace(graph(spark, [("new", "one", "r")]))
    assert store.load().counts() == (4, 2) and {r.id for r in store.load("other").nodes.collect()} == {"x", "y"}
    store.replace(graph(spark, []))
    assert store.load().counts() == (4, 2)


def test_of_two_writers_the_second_fails(spark, tmp_path):
    import pytest

    one, two = GraphStore(spark, str(tmp_path / "w")), GraphStore(spark, str(tmp_path / "w"))
    one.replace(graph(spark, [("a", "b", "r")]))
    seen = two.state()
    one.merge(graph(spark, [("b", "c", "r")]))
    number = one.state().number
    # The second, forced past the look at the folder, can't rename its state over the first one's.
    for look in (two._numbers, lambda: [seen.number]):
        two._numbers = look
        late = two._written(graph(spark, [("x", "y", "r")]), [])
        with pytest.raises(RuntimeError):
            two._commit(seen, [*seen.segments, late], late)
        assert not (tmp_path / "w" / late.name).exists() and not list((tmp_path / "w").glob("draft-*"))
    assert {r.id for r in one.load().nodes.collect()} == {"a", "b", "c"} and one.state().number == number


def size_of(folder, names):
    return sum(p.stat().st_size for n in names for p in (folder / n).rglob("*") if p.is_file())


def test_a_merge_writes_what_it_brings(spark, tmp_path):
    """However large the tenant is. Segments stay few, and other tenants' rows stay where they are."""
    store, folder = GraphStore(spark, str(tmp_path / "w")), tmp_path / "w"
    many = spark.range(60_000).select(F.concat(F.lit("node "), F.sha2(F.col("id").cast("string"), 256)).alias("node1"), F.concat(F.lit("end "), F.md5(F.col("id").cast("string"))).alias("node2"), F.lit("r").alias("relation"), F.lit(None).cast("string").alias("type1"), F.lit(None).cast("string").alias("type2"))
    store.replace(build_graph(as_triples(many), proximity=False))
    first = {s.name for s in store.state().segments}
    large = size_of(folder, first)
    written = 0
    for k in range(12):
        store.merge(graph(spark, [("b", f"c{k}", "r")], "other" if k % 3 else "default"), key=f"m{k}")
        state = store.state()
        assert first <= {s.name for s in state.segments} and len(state.segments) <= 5
        written += size_of(folder, {s.name for s in state.segments} - first)
    assert written < large / 4
    assert store.load("other").counts() == (9, 8) and store.load().counts() == (120_000 + 5 + 9, 60_000 + 12)
    store.compact()
    assert len(store.state().segments) == 1 and store.load().counts() == (120_000 + 5 + 9, 60_000 + 12)


def test_keys_are_merged_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "w"))
    small = graph(spark, [("a", "b", "r")])
    for key in ("k1", "k1", ("s", 0), ("s", 1), ("s", 0), ("s", 1), ("t", 0), "k1"):
        store.merge(small, key=key)
    assert store.load().edges.first().weight == 4.0 * 4 and store.state().batches == {"s": 1, "t": 0}


def test_segments_add_up_to_what_merging_in_turn_gives(spark, tmp_path):
    import random

    from thicket.operators.store import replace_tenant

    rng = random.Random(4)
    store, plain = GraphStore(spark, str(tmp_path / "w")), None
    for k in range(14):
        rows = [(rng.choice("abcdef"), rng.choice("abcdefgh"), rng.choice("rs"), rng.choice([None, "t", "u"]), rng.choice([None, "concept", "v"])) for _ in range(4)]
        g = graph(spark, rows, rng.choice(["x", "y"]))
        foreign = spark.createDataFrame([("a", "zz", "r", 1.0, "x"), ("a", "b", "q", 2.0, "y")], EDGE)
        g = Graph(g.nodes, g.edges.unionByName(foreign) if k % 4 == 1 else g.edges, g.chunks)
        if plain is None or k in (5, 9):
            tenant = "x"
            g = Graph(g.nodes.withColumn("tenant", F.lit(tenant)), g.edges.withColumn("tenant", F.lit(tenant)), g.chunks.withColumn("tenant", F.lit(tenant)))
            store.replace(g, tenant)
            plain = replace_tenant(plain, g, tenant) if plain else Graph(stored(g.nodes), g.edges, g.chunks)
        else:
            keep, recount = rng.random() < 0.5, k in (3, 11)
            store.merge(g, recount, keep)
            own = [r[0] for r in g.nodes.select("tenant").union(g.edges.select("tenant")).distinct().collect()]
            part = lambda x, inside: Graph(*[t.where(F.col("tenant").isin(own) == inside) for t in (x.nodes, x.edges, x.chunks)])
            rest, new = part(plain, False), merged(part(plain, True), g, recount, keep)
            plain = Graph(rest.nodes.unionByName(new.nodes), rest.edges.unionByName(new.edges), rest.chunks.unionByName(new.chunks))
        plain = Graph(*[spark.createDataFrame(t.collect(), t.schema) for t in (plain.nodes, plain.edges, plain.chunks)])
        if k % 3 == 2 or k > 11:
            got = store.tables()
            for a, b in ((got.nodes, plain.nodes), (got.edges, plain.edges), (got.chunks, plain.chunks)):
                assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())), k


def test_what_a_dead_writer_leaves_is_no_hindrance(spark, tmp_path):
    store, folder = GraphStore(spark, str(tmp_path / "w")), tmp_path / "w"
    store.replace(graph(spark, [("a", "b", "r")]))
    store._written(graph(spark, [("x", "y", "r")]), [])  # written, but never committed
    (folder / "draft-x").write_text('{"segm')
    store.merge(graph(spark, [("b", "c", "r")]))
    assert store.load().counts() == (3, 2)
    store.repair()
    assert store.load().counts() == (3, 2) and not (folder / "draft-x").exists()
    assert {p.name for p in folder.glob("s-*")} == {s.name for n in store._numbers() for s in store._read(n).segments}
    for k in range(5):
        store.merge(graph(spark, [("b", f"d{k}", "r")]))
    assert len(list(folder.glob("CURRENT.*"))) <= 3 and store.load().counts() == (8, 7)


def test_merge_options(spark):
    old, new = graph(spark, [("a", "b", "r", "Type", None)]), graph(spark, [("a", "b", "r"), ("a", "b", "q")])
    g = merged(Graph(stored(old.nodes), old.edges), new, recompute_degree=True, keep_known_types=True)
    n = {r.id: r for r in g.nodes.collect()}
    assert n["a"].entity_type == "type" and n["a"].degree == g.edges.count()


def test_fetch_defaults(spark):
    g = Graph(spark.createDataFrame([("a", None, -1, None, None, None)], NODE), spark.createDataFrame([("a", "zz", None, None, "t")], EDGE))
    r, e = fetched(g).nodes.first(), fetched(g).edges.first()
    assert (r.label, r.community, r.degree, r.tenant) == ("a", None, 0, "default") and (e.relation, e.weight) == ("related", 1.0)
    assert fetched(g, "t").edges.count() == 0


# --- search


def test_search(spark):
    g = graph(spark, [("Rust", "Tokio", "uses"), ("tokio", "io", "does"), ("io", "disk", "needs"), ("x", "y", "rusty")])
    got = {r.concept: [tuple(x) for x in r.related] for r in search(g, "RUST").collect()}
    assert got == {"rust": [("tokio", "uses")], "x": [("y", "rusty")], "y": [("x", "rusty")]}
    assert [r.concept for r in search(g, "", limit=2).collect()] == ["disk", "io"] and search(g, ".*").count() == 0
    deep = {r.concept: {x.edge for x in r.related} for r in search_depth(g, "rust", 2).collect()}
    assert deep == {"rust": {"uses", "does"}} and {x.edge for x in search_depth(g, "rust", 99).first().related} == {"uses", "does", "needs"}
    assert {(r.node, r.word, r.bits) for r in reach(spark.createDataFrame([("io", 0), ("x", 65)], "node string, seed long"), g.edges, 1).collect()} == {("io", 0, 1), ("disk", 0, 1), ("tokio", 0, 1), ("x", 1, 8), ("y", 1, 8)}


def test_depth_search_against_plain_walks(spark):
    """More seeds than a number has bits, cycles, nodes without edges and a term that every label holds."""
    import random

    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(60)], 2))) for _ in range(70)})
    g = graph(spark, [(a, b, rng.choice("rs")) for a, b in links])
    lone = spark.createDataFrame([("a lone n", "a lone n", None, 0, None, "default")], NODE)
    g = Graph(g.nodes.unionByName(lone), g.edges)
    edges = [(r.source, r.target, r.relation) for r in g.edges.collect()]
    ids = sorted({x for e in edges for x in e[:2]})
    for depth, limit, term in ((4, 20, "n"), (2, 70, "N"), (3, 5, "n1"), (1, 3, "")):
        want = set()
        for seed in [i for i in ids if term.lower() in i][:limit]:
            near = {seed}
            for _ in range(depth - 1):
                near |= {x for a, b, _ in edges if a in near or b in near for x in (a, b)}
            want |= {(seed, b, r) for a, b, r in edges if a in near or b in near}
        got = [tuple(r) for r in search_depth_rows(g, term, depth, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_the_seeds_that_are_shown_walk(spark, monkeypatch):
    from thicket.operators import search as module

    walked = []
    monkeypatch.setattr(module, "reach", lambda seeds, edges, steps: walked.append(seeds.count()) or reach(seeds, edges, steps))
    g = graph(spark, [(f"item {i:04d}", f"item {i + 1:04d}", "next") for i in range(300)])
    rows = search_depth_rows(g, "item", 10)
    assert walked == [20] and rows.select("concept").distinct().count() == 20 and rows.count() == sum(min(i + 10, 20) for i in range(20))


def test_session_and_views(spark):
    s = GraphSession(spark, sample(spark), "default")
    assert s.sql("SELECT max(degree) AS d FROM {nodes}").first().d == 3 and s.match().count() == 2 and s.match(directed=False).count() == 4
    assert json.loads(s.json(s.match().where("n_id = 'rust'").select("m_label")).first()["json"]) == {"m_label": "Tokio <&>"}
    assert [r.is_proximity for r in neighbours(sample(spark), "rust").collect()] == [False, True]
    assert filter_labels(sample(spark), "T", ("technology",)).count() == 2


# --- sinks


def test_csv_and_cypher(spark):
    g = sample(spark)
    assert [r.line for r in sinks.csv_nodes(g.nodes).orderBy("id").collect()] == ['"it\'s","it\'s",1,2', '"rust","Ru""st",3,0', '"tokio","Tokio <&>",0,1']
    assert [r.line for r in sinks.csv_edges(g.edges).orderBy("source").collect()] == ['"it\'s","rust","contextual proximity",0.5', '"rust","tokio","uses ""async""",4']
    assert "CREATE (n:Concept {id: 'it\\'s', label: 'it\\'s', degree: 1});" in [r.line for r in sinks.cypher_nodes(g.nodes).collect()]
    assert any(r.line.endswith("CREATE (a)-[:RELATES_TO {relation: 'uses \"async\"', weight: 4}]->(b);") for r in sinks.cypher_edges(g.edges).collect())


def test_files(spark, tmp_path):
    g = sample(spark)
    for fmt in sinks.FORMATS:
        sinks.export(g, fmt, str(tmp_path / fmt))
    whole = lambda p: subprocess.run(f"cat {p}/*/part-*", shell=True, capture_output=True, text=True, check=True).stdout
    (tmp_path / "g.graphml").write_text(whole(tmp_path / "graphml"))
    root = ET.parse(tmp_path / "g.graphml").getroot()
    assert len([x for x in root.iter() if x.tag.endswith("}node")]) == 3
    back = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.id, r.label) for r in back.nodes.collect()} == {(r.id, r.label) for r in g.nodes.collect()} and {(r.source, r.weight) for r in back.edges.collect()} == {("rust", 4.0), ("it's", 0.5)}
    assert whole(tmp_path / "csv.nodes.csv").splitlines()[0] == "id,label,degree,community" and len(whole(tmp_path / "csv.edges.csv").splitlines()) == 3
    assert whole(tmp_path / "cypher").count("CREATE (n:Concept") == 3
    text = "\n".join(r.line for r in sinks.json_document(g).orderBy("part", "a", "b", "c").collect())
    assert len(json.loads(text)["edges"]) == 2 and json.loads(text)["nodes"] == sorted(json.loads(text)["nodes"], key=lambda n: n["id"])
    assert json.loads("".join(r.line for r in sinks.json_document(Graph(g.nodes.limit(0), g.edges.limit(0))).orderBy("part").collect())) == {"nodes": [], "edges": []}
    assert "Tokio" in sinks.view_page(g) and sinks.view_counts(g.edges).first() == (1, 1)


def test_numbering(spark):
    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "n", "k").collect()
    assert all(r.n == r.k for r in rows) and len(rows) == 1000


# --- sources and selection


def test_files_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.txt": "plain", "sub/b.MD": "# Head", "c.html": "<body>x <b>y</b></body>", "d.json": "{}", "e.pdf": "%PDF-1.4"}.items():
        (tmp_path / name).write_text(text)
    got = {r.source.rsplit("/", 1)[1]: r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain", "b.MD": "Head", "c.html": "x y", "e.pdf": ""}
    assert read_documents(spark, str(tmp_path), strict=True).count() == 3


def test_manual_file(spark, tmp_path):
    import pytest

    f = tmp_path / "r.json"
    f.write_text('[{"node1": "A", "node2": "B", "relation": "r", "type1": "t"}, {"node1": "B", "node2": "C", "relation": "s"}]')
    assert build_graph(read_manual(spark, str(f))).nodes.count() == 3
    f.write_text('[{"node1": "A", "node2": "B"}]')
    with pytest.raises(Exception, match="relation"):
        read_manual(spark, str(f)).collect()
    assert manual(spark, [("a", "b", "r"), ("a", " ", "r"), ("a", "b", "")]).count() == 1 and as_triples(spark.createDataFrame([], "node1 string, node2 string, relation string, type1 string, type2 string")).count() == 0


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('default_provider = "openai"\nchunk_size = 900\n[providers.openai]\napi_key = "${K}"\nmodel = "m"\n[providers.google]\n[domain]\nname = "d"\nentity_types = ["x"]\n')
    c = load_config(str(f), {"K": "secret", "GEMINI_API_KEY": "g"})
    assert (c.provider, c.chunk_size, c.chunk_overlap, c.api_keys, c.models, c.domain.entity_types) == ("openai", 900, 150, {"openai": "secret", "google": "g"}, {"openai": "m"}, ["x"])
    assert [expand(v, {"A": "1"}) for v in ("${A}", "$A", "A", "$B", "x${A}")] == ["1", "1", "A", "", "x${A}"]
    (tmp_path / "ctx").write_text("more")
    assert with_context_file("c", str(tmp_path / "ctx")) == "c\n\nmore" and with_context_file("c", None) == "c"


def test_selection(spark):
    docs = spark.createDataFrame([(f"d/{i}.txt", "y" * 200) for i in range(8)] + [("d/readme.md", "y" * 200), ("e/x.json", "y" * 200), ("top.txt", "y" * 200)], "source string, text string")
    kept = [r.source for r in representative(docs, gate=None).collect()]
    assert sorted(kept) == ["d/0.txt", "d/1.txt", "d/2.txt", "d/3.txt", "d/readme.md", "top.txt"] and representative(docs).count() == 11
    ledger = spark.createDataFrame([("a", "h1", 1, 2, 1), ("b", "h", 1, 1, 1)], LEDGER)
    up = ledger_upsert(ledger, spark.createDataFrame([("a", "h2", 5, 6, 2)], LEDGER))
    assert {r.source: r.hash for r in up.collect()} == {"a": "h2", "b": "h"} and tuple(ledger_stats(up).first()) == (2, 6, 7) and tuple(ledger_stats(ledger.limit(0)).first()) == (0, 0, 0)
    assert unseen(docs, ledger).count() == 11


# --- command line


def test_commands(spark, tmp_path, capsys):
    docs, place, config = tmp_path / "docs", str(tmp_path / "wh"), str(tmp_path / "t.toml")
    docs.mkdir()
    (docs / "a.txt").write_text("Ownership prevents mistakes. Compilers enforce ownership everywhere.")
    base = ["--config", config, "--warehouse", place]
    run = lambda *a: (main([*base, *a], spark), capsys.readouterr().out)
    assert run("init")[0] == 0 and run("init")[0] == 1 and "anthropic" in run("auth")[1]
    assert "nodes" in run("build", str(docs))[1] and run("build", str(docs))[1] == "nothing new\n"
    assert run("add", "Ownership", "Borrowing", "--relation", "allows")[0] == 0 and run("add")[0] == 2
    assert "ownership" in run("query", "own")[1] and "prevents" in run("query", "owner", "--depth", "2")[1] and "n: " in run("query", "SQL: select count(*) as n from {nodes}")[1]
    code, out = run("path", "borrowing", "prevents")
    assert code == 0 and "ownership" in out and "cost" in out and run("path", "borrowing", "nowhere")[0] == 1
    assert "summary" in run("stats")[1] and "members" in run("communities")[1]
    assert run("export", "--format", "csv", "--output", str(tmp_path / "out"))[0] == 0 and run("viz", "--output", str(tmp_path / "v.html"))[0] == 0
    assert run("doctor")[0] == 0 and (tmp_path / "v.html").read_text().startswith("<!doctype")


def test_graphml_parts_are_read_by_element(spark, tmp_path, monkeypatch):
    """No row of text is more than an element: a part file of edges isn't one row to the reader of nodes, nor the reverse."""
    from pyspark.sql import DataFrameReader

    nodes = spark.range(3000).select(F.concat(F.lit("n <&> "), F.col("id").cast("string")).alias("id"), F.lit("label\n    x").alias("label"), F.lit(2).alias("degree"))
    edges = nodes.select(F.col("id").alias("source"), F.concat(F.lit("m"), "id").alias("target"), F.lit("r\n    </edge>").alias("relation"), F.lit(1.5).alias("weight"))
    sinks.export(Graph(nodes, edges), "graphml", str(tmp_path / "g"))
    seen, text = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **b: seen.append(text(self, *a, **b)) or seen[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")  # elements lie across splits, too
    try:
        back = read_graphml(spark, str(tmp_path / "g/*"), parts=True)
        assert {(r.id, r.degree) for r in back.nodes.collect()} == {(r.id, 2) for r in nodes.collect()} and back.nodes.count() == 3000
        assert {tuple(r)[:4] for r in back.edges.collect()} == {tuple(r) for r in edges.collect()} and back.edges.count() == 3000
        assert max(df.agg(F.max(F.length("value"))).first()[0] for df in seen) < 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
