"""Relations given by hand, ledgers and GraphML (survey ids SRC-09 to SRC-11, SRC-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.build import Graph
from thicket.operators.selection import ledger_upsert
from thicket.operators.sinks import GRAPHML_END
from thicket.schema import DEFAULT_TENANT, LEDGER, LEDGER_COLUMNS, MANUAL


def as_triples(manual: DataFrame, chunk_id: str = "manual") -> DataFrame:
    """(node_1, ..., edge, chunk_id, seq) of manual relations (node1, node2, relation, type1, type2)."""
    cols = [F.col("node1").alias("node_1"), F.col("type1").alias("node_1_type"), F.col("node2").alias("node_2"), F.col("type2").alias("node_2_type"), F.col("relation").alias("edge")]
    return manual.select(*cols, F.lit(chunk_id).alias("chunk_id"), F.monotonically_increasing_id().alias("seq"))


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: triples of a JSON array file; what doesn't parse fails, as does a relation without node1, node2 or relation."""
    rows = spark.read.schema(MANUAL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a relation has no {c}")).cast("string")).otherwise(F.col(c)).alias(c)
    return as_triples(rows.select(need("node1"), need("node2"), need("relation"), "type1", "type2"))


def manual(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """SRC-10: triples of (node1, node2, relation, type1, type2) tuples; empty ends or relations are left out."""
    kept = [r for r in ((*r, None, None)[:5] for r in rows) if r[0].strip() and r[1].strip() and r[2].strip()]
    return as_triples(spark.createDataFrame(kept, MANUAL))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: the ledger of ingested documents, each source's latest entry; empty if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if not there:
        return spark.createDataFrame([], LEDGER)
    return ledger_upsert(spark.read.schema(LEDGER).parquet(path), spark.createDataFrame([], LEDGER))


def append_ledger(entries: DataFrame, path: str) -> None:
    """Entries are only ever added; the latest of a source holds."""
    entries.select(*LEDGER_COLUMNS).write.mode("append").parquet(path)


def read_graphml(spark: SparkSession, path: str, tenant: str = DEFAULT_TENANT, parts: bool = False) -> Graph:
    """SRC-14: a graph of a GraphML file with node data label and degree and edge data relation and weight.

    parts: path has the part files of an export (a folder's glob), which make a document only when put together; they
    are read element by element, so a large file is split among tasks.
    """
    data = "data array<struct<_key:string,_VALUE:string>>"
    node, edge = f"_id string, {data}", f"_id string, _source string, _target string, {data}"

    def xml(tag: str, schema: str) -> DataFrame:
        if not parts:
            return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        # Cut where any element ends: files of the other kind, cut at this one's tag, would be one row each.
        rows = spark.read.option("lineSep", GRAPHML_END).text(path).select(F.regexp_extract("value", rf"(?s)(<{tag} .*)", 1).alias("x")).where("x <> ''")
        return rows.select(F.from_xml(F.concat("x", F.lit(f"{GRAPHML_END}{tag}>")), schema).alias("x")).select("x.*")

    get = lambda k: F.element_at(F.filter("data", lambda d: d["_key"] == k), 1)["_VALUE"]
    n = xml("node", node).select(
        F.col("_id").alias("id"), F.coalesce(get("label"), "_id").alias("label"), F.lit(None).cast("long").alias("community"), get("degree").cast("long").alias("degree"), F.lit(None).cast("string").alias("entity_type"), F.lit(tenant).alias("tenant")
    )
    e = xml("edge", edge).select(
        F.col("_source").alias("source"), F.col("_target").alias("target"), get("relation").alias("relation"), get("weight").cast("double").alias("weight"), F.lit(tenant).alias("tenant")
    )
    return Graph(n, e)
