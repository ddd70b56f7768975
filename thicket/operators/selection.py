"""Which documents are read, and in what batches (survey ids EXT-12, 13, 17 to 23, SRC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import content_hash, priority, skippable

PER_DIRECTORY, LARGE_CORPUS = 5, 100


def representative(docs: DataFrame, per_directory: int = PER_DIRECTORY, gate: int | None = LARGE_CORPUS, directory_col: str | None = None) -> DataFrame:
    """EXT-23: of each directory the per_directory documents worth most (the first by source, if equal), skipped ones
    apart. A corpus of up to gate documents stays as it is. docs has source and text."""
    if gate is not None and docs.limit(gate + 1).count() <= gate:
        return docs
    where = F.col(directory_col) if directory_col else F.regexp_replace("source", r"/?[^/]*$", "")
    order = Window.partitionBy("_dir").orderBy(F.desc("_score"), "source")
    kept = docs.where(~skippable("source", "text")).withColumns({"_dir": where, "_score": priority("source")})
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_directory).drop("_dir", "_score", "_rank")


def unseen(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """EXT-18: documents that aren't in the ledger with the text they have now."""
    return docs.withColumn("hash", content_hash("text")).join(ledger.select("source", "hash"), ["source", "hash"], "left_anti")


def ledger_upsert(ledger: DataFrame, news: DataFrame) -> DataFrame:
    """EXT-19: one entry for each source, the latest by ts (of equal ones, the new)."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(news.withColumn("_new", F.lit(1)))
    fields = [c for c in ledger.columns if c != "source"]
    return both.groupBy("source").agg(F.max_by(F.struct(*fields), F.struct("ts", "_new")).alias("e")).select("source", "e.*")


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """EXT-20."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return ledger.agg(F.count(F.lit(1)).alias("documents"), total("chunks_processed").alias("chunks"), total("relations_count").alias("relations"))


def batches(chunks: DataFrame, batch_size: int = 5) -> DataFrame:
    """EXT-12: (source, batch, chunks): the chunks of each source in order, batch_size (one at least) to a batch."""
    size = max(1, batch_size)
    return chunks.groupBy("source", F.floor(F.col("chunk_index") / size).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))


def batch_payload(batched: DataFrame) -> DataFrame:
    """EXT-13: (source, batch, payload): a header, then the numbered chunks, then an end mark."""
    head = F.concat(F.lit("Document: "), "source", F.lit(" (Batch "), F.col("batch").cast("string"), F.lit(")\n===CHUNK_SEPARATOR===\n"))
    body = F.array_join(F.transform("chunks", lambda c, i: F.concat(F.lit("\n---CHUNK_"), i.cast("string"), F.lit("---\n"), c["text"])), "")
    return batched.select("source", "batch", F.concat(head, body, F.lit("\n===END_DOCUMENT===\n")).alias("payload"))


def hierarchy(chunks: DataFrame, batch_size: int = 5) -> DataFrame:
    """EXT-17: triples that tie chunks to their batch and each batch to the next one."""
    batch = F.floor(F.col("chunk_index") / max(1, batch_size)).cast("long")
    name = lambda b: F.concat("source", F.lit("_batch_"), b.cast("string"))
    own = chunks.select("source", "chunk_index", batch.alias("batch"))

    def triple(one: Column, two: Column, kind: str, edge: str) -> list[Column]:
        return [one.alias("node_1"), F.lit("BatchSummary").alias("node_1_type"), two.alias("node_2"), F.lit(kind).alias("node_2_type"), F.lit(edge).alias("edge")]

    chunk = F.concat("source", F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    inside = own.select(*triple(name(F.col("batch")), chunk, "Chunk", "contains"))
    following = own.select("source", "batch").distinct().withColumn("next", F.lead("batch").over(Window.partitionBy("source").orderBy("batch"))).where("next is not null")
    return inside.unionByName(following.select(*triple(name(F.col("batch")), name(F.col("next")), "BatchSummary", "followed_by")))
