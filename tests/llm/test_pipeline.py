from pyspark.sql import functions as F

import corpus_pipeline
from thicket.llm.queries import ORACLE, QUERIES


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"} and set(ORACLE) <= set(QUERIES)


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    base = docs.where("length(text) > 800").orderBy("doc_id").first()
    bad = [(10_001, "12 34 --", "en", "s", 8), (10_002, None, "en", "s", 0), (10_003, base.text, base.lang, "s", base.n_chars), (10_004, f"before it {item} and after it", "en", "s", 9), (10_005, "write to zoe.77@mail1.example.com about the thing that was there", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = corpus_pipeline.staged(docs, "t")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "BPE encoding and decoding":
            assert docs.columns == names
        if name == "PII":
            text = docs.where("doc_id = 10005").first().text
            assert "zoe.77" not in text and "about the thing" in text
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    by = list(seen.values())
    assert {10_001, 10_002} & by[0] == set() and 10_003 in by[0] and 10_003 not in by[1] and 10_004 in by[1] and 10_004 not in by[2] and by[2] == by[3] == by[4]
    assert len(by[0]) >= 0.97 * 200


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Documents of the table with planted cases, repeated rows, null ids and extra columns: after each stage, what it
    kept is what plain Python keeps of what it got."""
    import hashlib

    from tests.llm.test_contamination import plain
    from tests.llm.test_near_duplicates import five_word_groups
    from tests.llm.test_pii import brute
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    long = docs.where("length(text) > 800").orderBy("doc_id").first()
    item = items.first().text
    more = [(None, long.text), (None, "no id, but words about the thing"), (900, long.text), (901, long.text.replace(" the ", " that ", 1)), (902, item), (902, item), (903, "12 34"), (904, None), (905, ""), (906, "Frau Schmidt and Anna, and Schmidt again about the thing that was")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema)
    docs = docs.unionByName(rows).selectExpr("*", "'a' AS row", "'b' AS hit", "'c' AS key", "'d' AS _gone")
    (tmp_path / "t").mkdir()
    docs.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    items.write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    got, kept = corpus_pipeline.run(spark, str(tmp_path / "t")).collect(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
        kept = corpus_pipeline.staged(stage(spark, kept, str(tmp_path / "t")), "t")
        after = kept.collect()
        assert kept.columns == docs.columns and {(r.row, r.hit, r.key, r._gone) for r in after} <= {tuple("abcd")}
        if name == "language ID":
            assert {903, 904, 905}.isdisjoint(r.doc_id for r in after) and all(any(c.isalpha() for c in r.text) for r in after)
            assert len(after) >= len(before) - 8
        elif name.endswith("near-dedup"):
            known = [r for r in before if r.doc_id is not None]
            want = {known[i].doc_id for i in five_word_groups([r.text for r in known])}
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in after) == 2
        elif name == "benchmark decontamination":
            bad = [x[-1] for x in plain([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in items.collect()])]
            assert sorted(map(str, (r.text for r in after))) == sorted(r.text for r, b in zip(before, bad) if not b)
        else:
            old, new = ({r.doc_id: r.text for r in x if r.doc_id is not None} for x in (before, after))
            assert old.keys() == new.keys() and len(before) == len(after)
            for i, spans in zip(old, brute(list(old.values()))):
                assert (old[i] != new[i]) == bool(spans)
    t = Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    want = sorted(hashlib.sha256(" ".join(map(str, t.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest() for r in kept.collect())
    assert sorted(r.ids_sha256 for r in got) == want


def test_stages_read_and_write_in_small_pieces(spark, sf):
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256, "parquet.block.size": 16 << 20}
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
    for name in limits:
        if not name.endswith("ReaderBatchSize"):
            own.conf.unset(name)
    corpus_pipeline.near_duplicates(own, own.read.parquet(f"{sf}/documents.parquet").limit(3), sf)
    assert {name: int(own.conf.get(name)) for name in limits} == limits | {"spark.sql.parquet.columnarReaderBatchSize": 64}
