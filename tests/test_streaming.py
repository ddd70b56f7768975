from thicket.operators.extract import RuleExtractor
from thicket.operators.store import GraphStore
from thicket.streaming.incremental import documents_to_graph, sessions, windowed_cooccurrence


def test_documents_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = spark.readStream.schema("source string, text string").json(str(tmp_path / "in"))
    store = GraphStore(spark, str(tmp_path / "wh"))

    def arrive(name, text):
        (tmp_path / "in" / name).write_text('{"source": "%s", "text": "%s"}' % (name, text))
        documents_to_graph(docs, store, str(tmp_path / "ledger"), str(tmp_path / "cp"), RuleExtractor, once=True).awaitTermination()
        return {(e.source, e.target): e.weight for e in store.load().edges.collect() if e.relation == "precedes"}

    assert arrive("a.json", "Ownership prevents mistakes.")[("ownership", "prevents")] == 5.0
    assert arrive("b.json", "Ownership prevents disasters.")[("ownership", "prevents")] == 10.0
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_windows(spark):
    rows = [("2024-01-01 00:01:00", 1, "a"), ("2024-01-01 00:02:00", 1, "b"), ("2024-01-01 00:03:00", 2, "a"), ("2024-01-01 01:10:00", 1, "b"), ("2024-01-01 01:20:00", 1, "a"), ("2024-01-01 01:21:00", 1, "c")]
    e = spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type")
    got = sorted((str(r.start), r.source, r.target, r.n) for r in windowed_cooccurrence(e).collect())
    assert got == [("2024-01-01 00:00:00", "a", "b", 1), ("2024-01-01 01:00:00", "a", "b", 1), ("2024-01-01 01:00:00", "a", "c", 1), ("2024-01-01 01:00:00", "b", "c", 1)]
    assert windowed_cooccurrence(e, "1 hour", "30 minutes").where("source = 'a' and target = 'b'").count() == 4
    assert sorted(r.n for r in sessions(e).collect()) == [1, 2, 3]


def test_windows_on_a_stream(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:01:00", 1, "a"), ("2024-01-01 00:02:00", 1, "b"), ("2024-01-02 00:00:00", 1, "a")], "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type")
    e.write.parquet(str(tmp_path / "e"))
    q = windowed_cooccurrence(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), late="10 minutes").writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.source, r.target) for r in spark.table("pairs").collect()] == [("a", "b")]


def test_stream_and_table_count_alike(spark, tmp_path):
    """Over several batches, with events that come late, but in time, and overlapping windows."""
    import random

    rng = random.Random(2)
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:{rng.randrange(60):02d}"
    for length, slide in (("1 hour", None), ("1 hour", "30 minutes")):
        folder = str(tmp_path / f"e{slide}")
        parts = [[(minute(max(0, 60 * k + rng.randrange(60) - (40 if rng.random() < 0.3 else 0))), rng.randrange(6), rng.choice("abc")) for _ in range(40)] for k in range(4)]
        for rows in [*parts, [("2024-01-02 00:00:00", 1, "a")], [("2024-01-02 06:00:00", 1, "a")]]:
            e = spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type")
            e.coalesce(1).write.mode("append").parquet(folder)
            name = f"alike_{slide or 'none'}".replace(" ", "_")
            stream = windowed_cooccurrence(spark.readStream.schema(e.schema).parquet(folder), length, slide, late="2 hours")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        table = windowed_cooccurrence(spark.read.parquet(folder), length, slide)
        got = sorted(map(str, spark.read.parquet(str(tmp_path / name)).select("start", "source", "target", "n").collect()))
        assert got == sorted(map(str, table.collect())) and len(got) > 10


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from thicket.operators.build import build_graph
    from thicket.sources.relations import append_ledger, manual, read_ledger

    store = GraphStore(spark, str(tmp_path / "wh"))
    graph = build_graph(manual(spark, [("a", "b", "r")]), proximity=False)
    for key in ("q1", "q1", "q2"):
        store.merge(graph, key=key)
    assert store.load().edges.first().weight == 8.0
    for ts, h in ((1, "x"), (3, "z"), (2, "y")):
        append_ledger(spark.createDataFrame([("a", h, 1, 1, ts)], "source string, hash string, chunks_processed long, relations_count long, ts long"), str(tmp_path / "l"))
    assert [r["hash"] for r in read_ledger(spark, str(tmp_path / "l")).collect()] == ["z"]
