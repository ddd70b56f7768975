import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import toxicity
from thicket.llm.toxicity import INPUT, STATE, STRIDE, WINDOW, Model, distinct_words, fit, forward, gradient, held_out, score, split_words, start_weights, train, windows

PLACES = ["th", "er", "on", "an", "ing", "ou", "é", "st", "ä", "ti"]


def bytes_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def drawn(n, seed=0, toxic=0.2):
    """Texts of invented words; toxic ones hold a few words with a beginning that others lack."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(PLACES, k=rng.randrange(1, 5)))
    out = []
    for i in range(n):
        words, label = [word() for _ in range(rng.choice([5, 40, 200]))], int(rng.random() < toxic)
        for _ in range(label * rng.randrange(1, 5)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["zuwx" + word(), "grumb"]))
        out.append((i, " ".join(words), label))
    return out


@pytest.fixture(scope="module")
def model():
    rows = drawn(400)
    return train([t for _, t, _ in rows], [y for _, _, y in rows], steps=150)


def test_words_of_texts():
    texts = ["", "ab  c9-d", "é", "x", "", "y z", "..", "ÿa"]
    data, ends = bytes_of(texts)
    start, end, of = split_words(data, ends)
    got = [(int(t), bytes(data[a:b]).decode()) for a, b, t in zip(start, end, of)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall("[a-z0-9\x80-\U0010ffff]+", t)]


def test_distinct_words_and_their_ngrams():
    texts = ["ab abc ab", "abc é", "q" * 50]
    data, ends = bytes_of(texts)
    start, end, _ = split_words(data, ends)
    words, own = distinct_words(data, start, end)
    assert len(words.digest) == 4 and own[0] == own[2] and own[1] == own[3]
    sizes = [words.count[k] for k in own]
    assert sizes == [sum(max(0, n + 2 - k + 1) for k in toxicity.GRAM_LENGTHS) for n in (2, 3, 2, 3, 2, 50)]
    alone, _ = distinct_words(*(lambda d: (d, np.array([0]), np.array([len(d)])))(np.frombuffer(b"abc", np.uint8)))
    k = own[1]
    assert alone.digest[0] == words.digest[k] and (alone.grams == words.grams[words.first[k] : words.first[k] + words.count[k]]).all()


@pytest.mark.parametrize("n", [0, 1, WINDOW - 1, WINDOW, WINDOW + 1, STRIDE + WINDOW, 500])
def test_windows_overlap_and_leave_no_word_out(n):
    first, size, of = windows(np.array([3, n, 0]))
    first, size = first[of == 1] - 3, size[of == 1]
    assert sorted({int(i) for f, s in zip(first, size) for i in range(f, f + s)}) == list(range(n))
    assert (np.diff(first) == STRIDE).all() and all(s == WINDOW for s in size[:-1]) and (of == 2).sum() == 1
    assert n == 0 or size[-1] > (0 if len(size) == 1 else WINDOW - STRIDE)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in start_weights(3).items()}
    x, live, target = rng.normal(0, 1, (6, 4, INPUT)), np.arange(6)[:, None] < np.array([6, 4, 1, 6]), rng.normal(0, 1, 4)
    cost = lambda: float(forward(w, x, live)[0] @ target)
    g, dx = gradient(w, x, forward(w, x, live, keep=True)[1], target)
    assert w["state_f"].shape == (STATE, 3 * STATE)
    for value, slope in [*((w[k], g[k]) for k in g), (x, dx)]:
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            was = value[at]
            value[at] = was + 1e-5
            up = cost()
            value[at] = was - 1e-5
            down = cost()
            value[at] = was
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_batches_and_pieces_score_like_texts_alone(model, monkeypatch):
    texts = [t for _, t, _ in drawn(30, seed=5)] + ["", "...", "grumb"]
    together = model.logits(*bytes_of(texts))
    alone = np.array([model.logits(*bytes_of([t]))[0] for t in texts])
    assert np.abs(together - alone).max() < 1e-4
    long = " ".join(t for _, t, _ in drawn(60, seed=6, toxic=0.05)) + " " + "w" * 3000
    monkeypatch.setattr(toxicity, "CALL_BYTES", 1000)
    assert abs(model.long_logit(bytes_of([long])[0]) - model.logits(*bytes_of([long]))[0]) < 1e-4


def test_words_never_seen_are_judged_by_their_characters(model):
    p = 1 / (1 + np.exp(-model.logits(*bytes_of(["the zuwxqqq an on", "the xuwzqqq an on"]))))
    assert p[0] >= 0.7 > p[1]


def test_held_out_rows(spark):
    rows = drawn(900, seed=2)
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = score(data.withColumn("held_out", held_out()), fit(data.select("doc_id", "text"), data.select("doc_id", "toxic").where(~held_out())), keep_text=False).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    kept = [r for r in got if r.held_out]
    assert len(kept) > 200 and sum(r.predicted == r.toxic for r in kept) / len(kept) > 0.97


def test_query_on_held_out_documents(spark):
    from thicket.llm.queries import op11_toxicity

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = op11_toxicity(spark, folder).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.75 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.97


def test_odd_rows(spark, model):
    texts = [None, "", " ", "...", "GRUMB", "grumb", "ab " * 800_000, "q" * 300_000, "grumb"]
    data = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(5, "grumb", "clash", "clash")], "doc_id long, text string, score string, lower string")
    got = score(data, model).orderBy("doc_id").collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 10 and by[0] == by[1] == by[2] == by[3] < 0.7 and by[4] == by[5] == by[8] >= 0.7 and all(0 <= r.score <= 1 and r.lower == "clash" for r in got)
    assert score(data.limit(0), model).count() == 0


def test_labels_that_tell_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(4)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows, p in [([], 0.0), ([(0, 1), (1, 1), (None, 0), (2, None)], 1.0), ([(0, 0)], 0.0)]:
        own = fit(docs, labels(rows))
        assert isinstance(own, Model) and own.weights is None and {r.score for r in score(docs, own).collect()} == {p}
    many = docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n")
    assert fit(many.unionByName(docs), labels([(0, 1), (1, 0)]), per_label=50).rate == pytest.approx(50 / 51)
