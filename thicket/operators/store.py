"""Stored graphs: tenants replaced and merged (survey ids STO, SRC-08).

merge_* and replace_* are functions from tables to tables. GraphStore keeps a graph as a row of segments: a write adds a
segment with what it brings, partitioned by tenant, and a state that lists the segments; readers add them up. So a merge
writes as much as it brings, whatever the tenant already has. Segments that are not much larger than those after them are
put together, so there are few of them, and a row is rewritten about as often as the graph has doubled since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.build import Graph
from thicket.schema import DEFAULT_TENANT, EDGE, EDGE_CHUNK, NODE

DEFAULT_TYPE = "concept"
#: States whose segments are kept for readers that began before the last writes; single keys of merges that are remembered.
KEEP_STATES, KEEP_KEYS = 3, 1000
#: A segment is put together with those after it if it has at most this times their bytes.
TIER = 2
_TABLES = {"nodes": NODE, "edges": EDGE, "chunks": EDGE_CHUNK}


def stored(nodes: DataFrame) -> DataFrame:
    """Nodes as they are stored: no community is 0, no type 'concept'."""
    return nodes.withColumns({"community": F.coalesce("community", F.lit(0)).cast("long"), "degree": F.coalesce("degree", F.lit(0)).cast("long"), "entity_type": F.coalesce("entity_type", F.lit(DEFAULT_TYPE))})


def fetched(graph: Graph, tenant: str | None = None) -> Graph:
    """SRC-08: nodes and edges with the defaults of missing values; with a tenant, only that one's, and edges only
    between its nodes."""
    n, e, chunks = graph.nodes, graph.edges, graph.chunks
    if tenant is not None:
        n, e = n.where(F.col("tenant") == tenant), e.where(F.col("tenant") == tenant)
        e = e.join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
        chunks = chunks.where(F.col("tenant") == tenant) if chunks is not None else None
    n = n.select(
        "id", F.coalesce("label", "id").alias("label"), F.when(F.col("community") >= 0, F.col("community")).alias("community"),
        F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "entity_type", F.coalesce("tenant", F.lit(DEFAULT_TENANT)).alias("tenant"),
    )
    more = [c for c in ("tenant",) if c in e.columns]
    return Graph(n, e.select("source", "target", F.coalesce("relation", F.lit("related")).alias("relation"), F.coalesce("weight", F.lit(1.0)).alias("weight"), *more), chunks)


def replace_tenant(old: Graph, new: Graph, tenant: str) -> Graph:
    """STO-01: old without what the tenant had, and new."""
    keep = lambda df: df.where(~F.col("tenant").eqNullSafe(tenant))
    chunks = _sum_chunks([g.chunks if g is new else keep(g.chunks) for g in (old, new) if g.chunks is not None])
    return Graph(keep(old.nodes).unionByName(stored(new.nodes)), keep(old.edges).unionByName(new.edges, allowMissingColumns=True), chunks)


def _brought(nodes: DataFrame, keep_known_types: bool) -> DataFrame:
    """Nodes as a merge brings them: with keep_known_types the default type is null, which says nothing."""
    rows = stored(nodes)
    return rows.withColumn("entity_type", F.nullif("entity_type", F.lit(DEFAULT_TYPE))) if keep_known_types else rows


def _sum_nodes(parts: list[DataFrame]) -> DataFrame:
    """STO-02 over nodes in the order that they came in: degrees add up, labels stay, of communities and types the last
    one that isn't null holds."""
    columns = ["id", "label", "community", "degree", "entity_type", "tenant"]
    rows = reduce(DataFrame.unionByName, [p.select(*columns, F.lit(k).alias("_k")) for k, p in enumerate(parts)])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_k"))).alias(c)
    label = F.min_by("label", F.when(F.col("label").isNotNull(), F.col("_k"))).alias("label")
    return rows.groupBy("id", "tenant").agg(label, last("community"), F.sum("degree").alias("degree"), last("entity_type")).select(*columns)


def _sum_edges(parts: list[DataFrame]) -> DataFrame:
    """STO-03: weights add up; another relation makes an edge beside."""
    columns = ["source", "target", "relation", "weight", "tenant"]
    rows = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return rows.groupBy("source", "target", "relation", "tenant").agg(F.sum("weight").alias("weight")).select(*columns)


def _sum_chunks(parts: list[DataFrame]) -> DataFrame | None:
    """A row for each edge and chunk, however often it came."""
    return reduce(DataFrame.unionByName, [p.select("source", "target", "chunk_id", "tenant") for p in parts]).distinct() if parts else None


def merge_nodes(old: DataFrame, new: DataFrame, keep_known_types: bool = False) -> DataFrame:
    """STO-02: by (id, tenant): degrees add up; community and type are the new ones, if the node is in new; labels stay.

    A type that is missing in new is stored as 'concept' even over a known one, unless keep_known_types.
    """
    return _sum_nodes([old, _brought(new, keep_known_types)]).withColumn("entity_type", F.coalesce("entity_type", F.lit(DEFAULT_TYPE)))


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """STO-03: by (source, target, relation, tenant): weights add up; another relation makes an edge beside. Edges of new
    whose ends aren't nodes of the tenant are left out."""
    have = lambda side: nodes.select(F.col("id").alias(side), "tenant")
    return _sum_edges([old, new.join(have("source"), ["source", "tenant"], "left_semi").join(have("target"), ["target", "tenant"], "left_semi")])


def merged(old: Graph, new: Graph, recompute_degree: bool = False, keep_known_types: bool = False) -> Graph:
    """Both merges. recompute_degree counts the merged edges instead of adding degrees, which count shared ones twice."""
    n = merge_nodes(old.nodes, new.nodes, keep_known_types)
    e = merge_edges(old.edges, new.edges, n)
    if recompute_degree:
        ends = e.select(F.explode(F.array("source", "target")).alias("id"), "tenant").groupBy("id", "tenant").agg(F.count(F.lit(1)).alias("_d"))
        n = n.drop("degree").join(ends, ["id", "tenant"], "left").withColumn("degree", F.coalesce("_d", F.lit(0)).cast("long")).select("id", "label", "community", "degree", "entity_type", "tenant")
    return Graph(n, e, _sum_chunks([g.chunks for g in (old, new) if g.chunks is not None]))


def store_counts(graph: Graph) -> DataFrame:
    """STO-05: one row: n_nodes, n_edges."""
    return graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))))


@dataclass
class Segment:
    """A folder of rows, its bytes, and the tenants of which earlier segments no longer count."""

    name: str
    size: int
    drops: list[str] = field(default_factory=list)


@dataclass
class State:
    """What a store holds: the number of the write that made it, its segments in order, the keys merged last, and of
    streams the last batch."""

    number: int = -1
    segments: list[Segment] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)

    def has(self, key: str | tuple[str, int] | None) -> bool:
        return self.batches.get(key[0], -1) >= key[1] if isinstance(key, tuple) else key in self.keys


class GraphStore:
    """A graph in a folder. STO-04: partitions by tenant stand for the index; a tenant's rows are read alone.

    State n is the file CURRENT.n. It is written under another name and renamed to its own, which fails if that exists: of
    two writers that began from the same state the second fails, and a writer that dies leaves the store as it was. (Hadoop's
    distributed file systems rename at once; on a plain local disk two writers must not commit in the same instant.)
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._files()
        return sorted(int(s.getPath().getName().split(".")[1]) for s in fs.globStatus(path(f"{self.folder}/CURRENT.*")) or [])

    def _read(self, number: int) -> State | None:
        """A state; None if its file isn't whole."""
        rows = self.spark.read.text(f"{self.folder}/CURRENT.{number}", wholetext=True).collect()
        try:
            content = json.loads(rows[0][0] if rows else "")
            return State(number, [Segment(**s) for s in content["segments"]], content["keys"], content["batches"])
        except ValueError:
            return None

    def state(self) -> State:
        """The last whole state."""
        return next((s for n in reversed(self._numbers()) if (s := self._read(n))), State())

    def load(self, tenant: str | None = None) -> Graph:
        return fetched(self.tables(None if tenant is None else [tenant]), tenant)

    def tables(self, tenants: list[str] | None = None, state: State | None = None) -> Graph:
        """The stored rows of some tenants, or of all: the segments, added up."""
        return self._added((state or self.state()).segments, tenants)

    def _added(self, segments: list[Segment], tenants: list[str] | None = None, defaults: bool = True) -> Graph:
        out = {}
        for name, add in (("nodes", _sum_nodes), ("edges", _sum_edges), ("chunks", _sum_chunks)):
            parts, gone = [], set()
            for s in reversed(segments):
                df = self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{s.name}/{name}")
                if tenants is not None:
                    df = df.where(F.col("tenant").isin(tenants))
                parts.append(df.where(~F.col("tenant").isin(sorted(gone))) if gone else df)
                gone |= set(s.drops)
            out[name] = add(parts[::-1]) if len(parts) > 1 else parts[0] if parts else self.spark.createDataFrame([], _TABLES[name])
        n = out["nodes"].withColumn("entity_type", F.coalesce("entity_type", F.lit(DEFAULT_TYPE))) if defaults else out["nodes"]
        return Graph(n, out["edges"], out["chunks"])

    def _written(self, graph: Graph, drops: list[str]) -> Segment:
        """A segment with the rows of graph, a node or an edge each once."""
        fs, path = self._files()
        name = f"s-{uuid.uuid4().hex}"
        chunks = graph.chunks if graph.chunks is not None else self.spark.createDataFrame([], EDGE_CHUNK)
        for part, df in (("nodes", _sum_nodes([graph.nodes])), ("edges", _sum_edges([graph.edges])), ("chunks", _sum_chunks([chunks]))):
            df.where(F.col("tenant").isNotNull()).write.partitionBy("tenant").parquet(f"{self.folder}/{name}/{part}")
        return Segment(name, fs.getContentSummary(path(f"{self.folder}/{name}")).getLength(), drops)

    def _commit(self, seen: State, segments: list[Segment], new: Segment, key: str | tuple[str, int] | None = None) -> None:
        """Makes the state after seen: these segments, and the new one at its place among them."""
        keys = [*seen.keys, key][-KEEP_KEYS:] if isinstance(key, str) else seen.keys
        batches = seen.batches | ({key[0]: key[1]} if isinstance(key, tuple) else {})
        fs, path = self._files()
        numbers = self._numbers()
        try:
            if numbers and numbers[-1] != seen.number:
                raise RuntimeError("the store was written meanwhile; read it again")
            draft = path(f"{self.folder}/draft-{new.name}")
            out = fs.create(draft, True)
            out.write(bytearray(json.dumps({"segments": [asdict(s) for s in segments], "keys": keys, "batches": batches}).encode()))
            out.close()
            jvm = self.spark._jvm
            never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, path(f"{self.folder}/CURRENT.{seen.number + 1}"), never_over)
            except Py4JJavaError as e:
                fs.delete(draft, False)
                raise RuntimeError("the store was written meanwhile; read it again") from e
        except RuntimeError:
            fs.delete(path(f"{self.folder}/{new.name}"), True)
            raise
        self._forget(seen.number + 1)

    def _forget(self, last: int) -> None:
        """Deletes the states before the last KEEP_STATES, and the segments that only those name."""
        fs, path = self._files()
        old = [n for n in self._numbers() if n <= last - KEEP_STATES]
        kept = {g.name for n in self._numbers() if n not in old and (s := self._read(n)) for g in s.segments}
        for n in old:
            gone = self._read(n)
            for name in {g.name for g in gone.segments} - kept if gone else ():
                fs.delete(path(f"{self.folder}/{name}"), True)
            fs.delete(path(f"{self.folder}/CURRENT.{n}"), False)

    def repair(self) -> None:
        """Removes what broken writes left: drafts, segments that no state names, states that aren't whole. For when no
        writer is at work; a store works without it."""
        fs, path = self._files()
        named = set()
        for n in self._numbers():
            if (s := self._read(n)) is None:
                fs.delete(path(f"{self.folder}/CURRENT.{n}"), False)
            else:
                named |= {g.name for g in s.segments}
        for pattern in ("draft-*", "s-*"):
            for found in fs.globStatus(path(f"{self.folder}/{pattern}")) or []:
                if found.getPath().getName() not in named:
                    fs.delete(found.getPath(), True)

    def replace(self, graph: Graph, tenant: str = DEFAULT_TENANT) -> None:
        """STO-01. A graph without nodes leaves the store as it is: an unchanged corpus is no reason to empty it."""
        if graph.nodes.limit(1).count():
            seen = self.state()
            new = self._written(Graph(stored(graph.nodes), graph.edges, graph.chunks), [tenant])
            self._commit(seen, [*seen.segments, new], new)
            self._tidy()

    def merge(self, graph: Graph, recompute_degree: bool = False, keep_known_types: bool = False, key: str | tuple[str, int] | None = None) -> None:
        """STO-02, STO-03: adds a segment with the graph's rows. A key names what is merged; it is merged once, however
        often it comes. Of a key (stream, number) the stream's greatest number is remembered.

        recompute_degree counts all edges of the tenants, so it writes these tenants anew.
        """
        seen = self.state()
        if seen.has(key) or not (graph.nodes.limit(1).count() or graph.edges.limit(1).count()):
            return
        if recompute_degree:
            tenants = sorted(r[0] for r in graph.nodes.select("tenant").union(graph.edges.select("tenant")).distinct().collect() if r[0] is not None)
            new = self._written(merged(self.tables(tenants, seen), graph, True, keep_known_types), tenants)
        else:
            new = self._written(Graph(_brought(graph.nodes, keep_known_types), self._held(graph, seen), graph.chunks), [])
        self._commit(seen, [*seen.segments, new], new, key)
        self._tidy()

    def _held(self, graph: Graph, seen: State) -> DataFrame:
        """The graph's edges whose ends are nodes, its own or stored ones. Stored nodes are looked at only for ends that
        it doesn't bring itself."""
        ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id"), "tenant").distinct()
        foreign = ends.join(graph.nodes.select("id", "tenant"), ["id", "tenant"], "left_anti")
        if not foreign.limit(1).count():
            return graph.edges
        lost = foreign.join(self.tables(None, seen).nodes.select("id", "tenant"), ["id", "tenant"], "left_anti")
        out = graph.edges
        for side in ("source", "target"):
            out = out.join(lost.select(F.col("id").alias(side), "tenant"), [side, "tenant"], "left_anti")
        return out

    def _tidy(self) -> None:
        """Puts the last segments together as TIER asks. If another writer is faster, they stay for the next time."""
        segments = self.state().segments
        first = len(segments) - 1
        size = segments[first].size
        while first > 0 and segments[first - 1].size <= TIER * size:
            first -= 1
            size += segments[first].size
        if first < len(segments) - 1:
            try:
                self.compact(first)
            except RuntimeError:
                pass

    def compact(self, first: int = 0) -> None:
        """Writes the segments from this one on as one."""
        seen = self.state()
        own = seen.segments[first:]
        if len(own) > 1:
            drops = sorted({t for s in own for t in s.drops}) if first else []
            new = self._written(self._added(own, defaults=False), drops)
            self._commit(seen, [*seen.segments[:first], new], new)
