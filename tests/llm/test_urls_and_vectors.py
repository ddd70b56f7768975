import numpy as np
import pytest

from thicket.llm.ann import codebook, neighbours, walk
from thicket.llm.queries import HOST_RULES
from thicket.llm.url_filter import PATTERNS, host_rule, judge, pattern_regex, pattern_tokens, rule_table

URLS = {
    "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://Example.NET/de/": ("example.net", "/de/", "net/", "block"),
    "http://example.com/de/x?y": ("example.com", "/de/x", "example.com/de/", "block"),
    "http://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
    "ftp://w.org/fr/#t": ("w.org", "/fr/", "org/fr/", "allow"),
    "http://w.org/FR/": ("w.org", "/FR/", None, "allow"),
    "http://x.net": ("x.net", "", None, "allow"),
    "http://x.net?q=http://b.net/": ("x.net", "", None, "allow"),
    "http://m.adult-x.example.com/en/": ("m.adult-x.example.com", "/en/", None, "block"),
    "http://m.unadult-x.example.com/en/": ("m.unadult-x.example.com", "/en/", None, "allow"),
    "http://adult-x.org/fr/": ("adult-x.org", "/fr/", "org/fr/", "allow"),
    "nothing": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_verdicts(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(99, None, "clash"), (0, "http://a.example.net/en/1", "clash")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string"), rule_table(spark, HOST_RULES, PATTERNS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS.get(r.url, ("", "", None, "allow"))


def test_clashing_names_of_pages(spark):
    names = ["u", "r", "p", "judged", "url_", "token", "n", "target", "copies"]
    rows = [(i, u, *names) for i, u in enumerate(URLS)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, " + ", ".join(f"{n} string" for n in names)), rule_table(spark, HOST_RULES, PATTERNS)).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == URLS and all(tuple(r)[2:11] == tuple(names) for r in got)


def test_empty_tables(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), rule_table(spark, HOST_RULES, PATTERNS)
    assert judge(pages, rules).count() == 0
    assert judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), rules.limit(0)).first().verdict == "allow"


def test_rules_are_read():
    assert host_rule("Example.net/en/a") == ("example.net", "/en/a", ["example", "net", "en"])
    assert pattern_tokens("||ads-") == ["ads"] and pattern_tokens("*promo*") == [] and pattern_tokens("/click^track/*x") == ["click", "track"]
    import re

    assert re.search(pattern_regex("/ad^*.gif"), "h/ad/x/y.gif") and not re.search(pattern_regex("||ads."), "x/ads.com")


def test_rules_without_tokens_are_tried_on_all(spark):
    rules = rule_table(spark, [], [("block", "*promo*")])
    got = judge(spark.createDataFrame([(1, "http://a.com/xpromox"), (2, "http://a.com/y")], "page_id long, url string"), rules).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


# --- vectors


def brute(rows, queries, k=10):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors[i] = np.array(v, np.float32).astype(float)
    ids = np.array(list(vectors))
    x = np.stack(list(vectors.values()))
    out = {}
    for q in queries:
        if q in vectors:
            d = np.sqrt(((x - vectors[q]) ** 2).sum(axis=1))
            out[q] = [(int(ids[j]), d[j]) for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if ids[j] != q][:k]
    return out


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [m[i] for i in sorted(m)] for q, m in out.items()}


def test_walk_goes_by_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    order = walk(a, b, np.ones(35, int), 35)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(35)) and sums == sorted(sums) and len(walk(a, b, np.ones(35, int), 4)) == 4


def test_codebook_of_few_rows():
    assert len(codebook(np.ones((9, 3)))) == 1


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = found(neighbours(df, df.where("vec_id % 100 = 0"))), brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(w) for q, w in brute(rows, want, k=10**6).items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, g in got.items() for i, s in g)


@pytest.mark.parametrize("share", [1.0])
def test_exact_with_all_cells_ties_and_odd_rows(spark, share):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 6).astype(float).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(300)]
    rows += [(2000, None), (2100, [0.0] * 6), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] + [0.0] * 5), (2500, []), (2600, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 6], range(0, 3000, 100))
    got = found(neighbours(df, df.where("vec_id % 100 = 0"), share=share))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(neighbours(df, df.where("vec_id = 0"))) == {0: [(1, 2**0.5)]}
    assert neighbours(df.limit(0), df).count() == 0 and neighbours(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert neighbours(one, one).count() == 0


def test_lengths_apart(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)] + [(100 + i, [1.0, 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([r for r in rows if len(r[1]) == 3], [0])
    asked = spark.createDataFrame([(0, rows[0][1]), (100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [3.0])], "vec_id long, embedding array<float>")
    got = found(neighbours(df, asked, share=1.0))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert neighbours(df, asked.where("vec_id > 0")).count() == 0


def test_calls_are_bounded(spark, monkeypatch):
    from thicket.llm import ann

    monkeypatch.setattr(ann, "BLOCK_ROWS", 32)
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(4).tolist()) for i in range(500)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, slice int, block int")
    got, want = found(ann.neighbours(df, df.where("vec_id % 10 = 0"), share=1.0)), brute(rows, range(0, 500, 10))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_share_is_measured_on_clustered_vectors(spark):
    """20,000 vectors in 400 clusters: a small share finds nine tenths of the neighbours and more."""
    from thicket.llm import ann

    rng = np.random.default_rng(5)
    x = (rng.normal(0, 1, (400, 16))[rng.integers(0, 400, 20_000)] + rng.normal(0, 0.1, (20_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    seen = []
    real = ann.measured_share
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ann, "LEAST", 100)
        m.setattr(ann, "measured_share", lambda *a: seen.append(real(*a)) or seen[-1])
        got = {(r.query_id, r.vec_id) for r in neighbours(df, df.where("vec_id % 100 = 0")).collect()}
    wide = x.astype(float)
    want = {(q, int(j)) for q in range(0, 20_000, 100) for j in [i for i in np.argsort(((wide - wide[q]) ** 2).sum(axis=1), kind="stable")[:11] if i != q][:10]}
    assert seen[0] < 0.2 and len(got) == len(want) == 2000 and len(got & want) / len(want) >= 0.9
