import hashlib
import random
import re

import pytest

from thicket.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items):
    windows: dict = {}
    for i, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    sizes = {len(k) for k in windows}
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= s
                    hit[k : k + n] = [1] * n
        yield (d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)


def made(seed: int):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "Éa", "x9", "漢", "word"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([10, 11, 25, 40, 7, 3, 10, 60])] + [(50, None), (51, "--- !"), (52, "zz zz zz zz zz zz zz zz zz zz zz"), (None, "only " * 12)]
    docs = []
    for d in range(60):
        w = words(rng.choice([0, 4, 30, 120]))
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            part = source.split()
            at, k = rng.randrange(len(part) + 1), rng.randrange(len(w) + 1)
            w[k:k] = part[at : at + rng.randrange(5, 30)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "zz " * 3000), (102, "zz " * 3000), (103, "only " * 30), (None, "zz " * 11)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, items = made(seed)
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, w string")
    got = contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(docs, items)))


def test_without_items_or_documents(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, i).collect()] == [(1, 2, 0, 0)]
    assert contamination(d.limit(0), i).count() == 0


def test_dropping(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = [(1, text), (2, "One, two: three four five six seven eight nine ten!"), (3, "one two three four five six seven eight nine"), (None, text), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS _row", "'b' AS row", "'c' AS _tag", "'d' AS row_", "'e' AS w")
    out = drop_contaminated(d, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert out.columns == d.columns and {tuple(r)[2:] for r in out.collect()} == {tuple("abcde")}
    assert sorted(r.doc_id for r in drop_contaminated(d, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()) == [3, 4]


def test_extra_columns_of_items(spark):
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, text, "x", 5)], "doc_id long, text string, item string, n int")
    i = spark.createDataFrame([(9, text, "y", 6), (9, text, "z", 7)], "item_id long, text string, gram string, n int")
    assert [tuple(r)[:4] for r in contamination(d, i).collect()] == [(1, 11, 11, 1)]


def test_a_window_that_all_items_share(spark):
    text = " ".join(f"w{k}" for k in range(10))
    d = spark.createDataFrame([(k, (text + " x ") * 20) for k in range(3)], "doc_id long, text string")
    i = spark.createDataFrame([(k, text) for k in range(500)], "item_id long, text string")
    assert {(r.n_hit, r.n_items) for r in contamination(d, i).collect()} == {(200, 500)}


def test_no_python_in_the_plan(spark):
    docs, items = made(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = contamination(d, i)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
