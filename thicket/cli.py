"""Command line: build, add, query, path, stats, communities, export, viz, doctor, init, auth (survey ids OPS, QRY-05)."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import algorithms, communities, sinks
from thicket.operators.build import Graph, build_graph, rebuilt
from thicket.operators.extract import HttpExtractor, extractor
from thicket.operators.search import GraphSession, search, search_depth
from thicket.operators.store import GraphStore
from thicket.plans.ingest import ingest
from thicket.schema import DEFAULT_TENANT
from thicket.sources.config import Config, load_config, with_context_file
from thicket.sources.files import read_documents
from thicket.sources.relations import append_ledger, manual, read_ledger, read_manual

TENANT_VARIABLE = "THICKET_TENANT"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thicket", description="Knowledge graphs on Spark")
    top.add_argument("--config", default="thicket.toml")
    top.add_argument("--warehouse", help="folder of the stored graph")
    top.add_argument("--tenant", default=os.environ.get(TENANT_VARIABLE))
    verbs = top.add_subparsers(dest="verb", required=True)
    verb = lambda name, text: verbs.add_parser(name, help=text)
    p = verb("init", "make the warehouse folder and a configuration")
    p.add_argument("--force", action="store_true")
    p = verb("auth", "which providers have a key in the environment")
    p.add_argument("--list", action="store_true")
    p = verb("build", "documents to a graph")
    p.add_argument("path")
    p.add_argument("--provider", choices=["rules", *sorted(HttpExtractor.KINDS)])
    p.add_argument("--model")
    p.add_argument("--output", default="store", choices=["store", "json", "csv"])
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--chunk-overlap", type=int)
    p.add_argument("--append", action="store_true")
    p.add_argument("--per-directory", type=int, help="of more than 100 documents, read the best of each directory only")
    p.add_argument("--domain")
    p.add_argument("--context")
    p.add_argument("--context-file")
    p = verb("add", "relations given by hand")
    p.add_argument("node1", nargs="?")
    p.add_argument("node2", nargs="?")
    p.add_argument("--relation")
    p.add_argument("--type1")
    p.add_argument("--type2")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("--from-file")
    p = verb("query", "search for a term, or sql: and a query over {nodes} and {edges}")
    p.add_argument("text")
    p.add_argument("--depth", type=int, default=1)
    p = verb("path", "cheapest path")
    p.add_argument("start")
    p.add_argument("end")
    verb("stats", "figures of the graph")
    verb("communities", "communities and their members")
    p = verb("export", "write the graph to files")
    p.add_argument("--format", default="json", choices=sinks.FORMATS)
    p.add_argument("--output", required=True)
    p = verb("viz", "a page that draws the graph")
    p.add_argument("--output", default="graph.html")
    verb("doctor", "check what is needed")
    return top


def render(rows: DataFrame, most: int = 100, out=None) -> None:
    """QRY-05: numbered rows of name: value."""
    for i, row in enumerate(rows.limit(most).collect(), 1):
        print(f"{i}. " + ", ".join(f"{k}: {v}" for k, v in row.asDict(recursive=True).items()), file=out or sys.stdout)


def interactive(spark: SparkSession, ask=input) -> DataFrame:
    """SRC-10: relations until an empty first node; those with an empty second node or relation are left out."""
    rows = []
    while first := ask("node 1 (empty to end): ").strip():
        rows.append((first, ask("node 2: "), ask("relation: ")))
    return manual(spark, rows)


def doctor(spark: SparkSession, store: GraphStore, config: Config) -> list[tuple[str, str, str]]:
    """OPS-03: (what, pass | warn | fail, more)."""
    found = [("spark", "pass", spark.version)]
    try:
        n, e = store.load().counts()
        found.append(("warehouse", "pass" if n else "warn", f"{n} nodes, {e} edges"))
    except Exception as problem:  # whatever keeps the store from being read is what the check is for
        found.append(("warehouse", "fail", str(problem).splitlines()[0]))
    name = config.provider
    key = HttpExtractor.KINDS[name][2] if name in HttpExtractor.KINDS else None
    found.append(("provider", "pass" if key is None or os.environ.get(key) or config.api_keys.get(name) else "warn", f"{name}: {key or 'needs no key'}"))
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = load_config(a.config) if Path(a.config).exists() else Config()
    place = a.warehouse or config.warehouse
    if a.verb == "init":
        if Path(a.config).exists() and not a.force:
            print(f"{a.config} exists; --force replaces it")
            return 1
        Path(place).mkdir(parents=True, exist_ok=True)
        Path(a.config).write_text(f'default_provider = "rules"\nwarehouse = "{place}"\nchunk_size = {config.chunk_size}\nchunk_overlap = {config.chunk_overlap}\n', encoding="utf-8")
        return 0
    if a.verb == "auth":
        for name, (_, _, key) in sorted(HttpExtractor.KINDS.items()):
            print(f"{name}: {'no key needed' if key is None else 'set' if os.environ.get(key) or config.api_keys.get(name) else f'{key} is not set'}")
        return 0
    spark = spark or SparkSession.builder.appName("thicket").getOrCreate()
    store, tenant = GraphStore(spark, place), a.tenant or config.tenant or DEFAULT_TENANT
    if a.verb == "doctor":
        checks = doctor(spark, store, config)
        for what, state, more in checks:
            print(f"{state}: {what} ({more})")
        return int(any(s == "fail" for _, s, _ in checks))
    if a.verb == "build":
        domain = config.domain
        context = with_context_file(a.context, a.context_file)
        if a.domain or context:
            from thicket.operators.extract import Domain

            domain = Domain(a.domain or (domain and domain.name), context or (domain and domain.context), domain.entity_types if domain else [], domain and domain.focus)
        provider = a.provider or config.provider
        ledger_path = f"{place}/ledger-{tenant}"
        ledger = read_ledger(spark, ledger_path)
        make = extractor(provider, a.model, config.models.get(provider), domain)
        sizes = {"chunk_size": a.chunk_size or config.chunk_size, "overlap": a.chunk_overlap or config.chunk_overlap}
        graph, entries = ingest(spark, read_documents(spark, a.path), ledger, make, tenant, per_directory=a.per_directory, **sizes)
        if not entries.limit(1).count():
            print("nothing new")
            return 0
        if a.output != "store":
            sinks.export(graph, a.output, f"{a.path.rstrip('/')}.kg")
        elif a.append:
            store.merge(graph)
        else:
            store.replace(graph, tenant)
        append_ledger(entries, ledger_path)
        print("{} nodes, {} edges".format(*graph.counts()))
        return 0
    if a.verb == "add":
        if a.from_file:
            rows = read_manual(spark, a.from_file)
        elif a.interactive:
            rows = interactive(spark)
        elif a.node1 and a.node2 and a.relation:
            rows = manual(spark, [(a.node1, a.node2, a.relation, a.type1, a.type2)])
        else:
            print("give two nodes and --relation, --from-file or --interactive")
            return 2
        store.merge(build_graph(rows, tenant, proximity=False))
        return 0
    graph = store.load(a.tenant)
    if a.verb == "query":
        if a.text.lower().startswith("sql:"):
            render(GraphSession(spark, graph).sql(a.text[4:].strip()))
        else:
            render(search(graph, a.text) if a.depth <= 1 else search_depth(graph, a.text, a.depth))
    elif a.verb == "path":
        g = rebuilt(graph)
        path = algorithms.shortest_path(g.nodes, g.edges, a.start.lower(), a.end.lower())
        hops = algorithms.annotated(path, graph.edges).orderBy("step").collect()
        total = path.agg(F.max("cost")).first()[0]
        if total is None:
            print("no path")
            return 1
        for h in hops:
            print(f"{h['from']} -[{h['relation']}]-> {h['to']}")
        print(f"cost {total:.3f}")
    elif a.verb == "stats":
        parts = algorithms.graph_stats(rebuilt(graph))
        for name, rows in parts.items():
            print(f"{name}:")
            render(rows)
        render(algorithms.type_counts(graph.nodes))
    elif a.verb == "communities":
        g = rebuilt(graph)
        labels = communities.label_propagation(g.nodes, g.edges)
        sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
        render(sizes.join(communities.first_members(labels), "community").orderBy(F.desc("size"), "community"))
        render(communities.type_histogram(graph.nodes, labels).orderBy("community", F.desc("n"), "entity_type"))
    elif a.verb == "export":
        sinks.export(Graph(graph.nodes, graph.edges), a.format, a.output)
    elif a.verb == "viz":
        Path(a.output).write_text(sinks.view_page(graph), encoding="utf-8")
    return 0
