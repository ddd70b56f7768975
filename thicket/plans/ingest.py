"""From document files to a stored graph (the build command)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.chunking import chunk_id, chunks, rejoined, token_chunks
from thicket.functions.persist import cut
from thicket.functions.text import content_hash
from thicket.operators.answers import parse_answers
from thicket.operators.build import Graph, build_graph
from thicket.operators.extract import Extractor, extract
from thicket.operators.selection import batch_payload, batches, representative, unseen
from thicket.schema import DEFAULT_TENANT, LEDGER_COLUMNS


def triples_of(docs: DataFrame, make: Callable[[], Extractor], chunk_size: int = 1500, overlap: int = 150, target: int = 1000, batch_size: int = 5, strict: bool = True) -> DataFrame:
    """Triples of documents (source, text): chunked, put together again, chunked by tokens, batched, extracted, parsed.

    A triple's chunk is its batch: what one call saw is what is near.
    """
    whole = rejoined(chunks(docs, chunk_size, overlap))
    batched = batches(token_chunks(whole, target), batch_size)
    asked = batch_payload(batched).join(batched, ["source", "batch"])
    answered = cut(extract(asked, make, target=target), "answers").where("status = 'ok'")
    rows = parse_answers(answered.select("source", "batch", "part", "answer"), strict=strict)
    return rows.select("node_1", "node_1_type", "node_2", "node_2_type", "edge", chunk_id("source", F.col("batch")).alias("chunk_id"), F.struct("source", "batch", "part", "pos").alias("seq"))


def ingest(spark: SparkSession, docs: DataFrame, ledger: DataFrame, make: Callable[[], Extractor], tenant: str = DEFAULT_TENANT, communities: str | None = "async", per_directory: int | None = None, gate: int = 100, **options) -> tuple[Graph, DataFrame]:
    """(graph of the documents that are new or changed, their ledger entries).

    All documents are read, unless per_directory is given: then, of more than gate documents, that many of each directory.
    """
    some = docs if per_directory is None else representative(docs, per_directory, gate)
    new = cut(unseen(some, ledger), "unseen")
    triples = cut(triples_of(new.select("source", "text"), make, **options), "triples")
    per_source = triples.groupBy(F.col("seq.source").alias("source")).agg(F.count(F.lit(1)).alias("relations_count"), F.count_distinct("chunk_id").alias("chunks_processed"))
    now = F.unix_timestamp(F.current_timestamp())
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    entries = new.select("source", content_hash("text").alias("hash")).join(per_source, "source", "left")
    entries = entries.select("source", "hash", count("chunks_processed"), count("relations_count"), now.cast("long").alias("ts"))
    return build_graph(triples, tenant, communities=communities), entries.select(*LEDGER_COLUMNS)
