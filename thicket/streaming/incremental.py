"""Streams into a stored graph, and windowed co-occurrence of events (survey id EXT-STREAM)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.functions.persist import cut
from thicket.functions.text import content_hash
from thicket.operators.build import build_graph
from thicket.operators.extract import Extractor
from thicket.operators.selection import unseen
from thicket.operators.store import GraphStore
from thicket.plans.ingest import triples_of
from thicket.schema import DEFAULT_TENANT
from thicket.sources.relations import append_ledger, read_ledger


def documents_to_graph(docs: DataFrame, store: GraphStore, ledger_path: str, checkpoint: str, make: Callable[[], Extractor], tenant: str = DEFAULT_TENANT, once: bool = False, **options) -> StreamingQuery:
    """Merges the triples of a stream of documents (source, text) into a store, a batch at a time.

    A batch that is repeated after a failure changes nothing: the store takes a batch's key once, and the ledger, which is
    added to after the merge, keeps a document with the same text from being read again.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        ledger = read_ledger(spark, ledger_path)
        new = cut(unseen(df.select("source", "text").dropDuplicates(["source"]), ledger), "unseen")
        if not new.limit(1).count():
            return
        triples = cut(triples_of(new.select("source", "text"), make, **options), "triples")
        store.merge(build_graph(triples, tenant), key=(name, number))
        counts = triples.groupBy(F.col("seq.source").alias("source")).agg(F.count_distinct("chunk_id").alias("chunks_processed"), F.count(F.lit(1)).alias("relations_count"))
        count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        entries = new.select("source", content_hash("text").alias("hash")).join(counts, "source", "left")
        entries = entries.select("source", "hash", count("chunks_processed"), count("relations_count"), F.lit(number).cast("long").alias("ts"))
        append_ledger(entries, ledger_path)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_cooccurrence(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, source, target, n): how often two event types occurred for one user in one window, source < target.

    Works on a table or, with late (how long to wait for late events), on a stream in append mode: a window's counts come
    once it is closed, and are those that the table gives. Types, not events, are paired: the types of a user's window are
    few.
    """
    rows = events.withWatermark("ts", late) if late else events
    per_user = rows.groupBy(F.window("ts", length, slide).alias("w"), "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    each = F.transform("types", lambda a: F.transform("types", lambda b: F.struct(a.alias("source"), b.alias("target"))))
    pairs = F.filter(F.flatten(each), lambda p: p["source"] < p["target"])
    # On a stream the second aggregate needs an event time of its own: the moment at which a user's window ends.
    ended = [F.window(F.window_time("w"), slide or length).alias("ended")] if late else []
    rows = per_user.select(F.col("w.start").alias("start"), *ended, F.explode(pairs).alias("p"))
    keys = ["start", F.col("p.source").alias("source"), F.col("p.target").alias("target")]
    return rows.groupBy(*(["ended"] if late else []), *keys).agg(F.count(F.lit(1)).alias("n")).select("start", "source", "target", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, stop, n): a user's events with no longer pause than gap between them."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
