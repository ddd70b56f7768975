import hashlib
import math

import numpy as np
import pytest

from thicket.llm.vector_codes import MOST, SCALE, compress, cuts, decoded, fit, kd_tree, nearest, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def brute(rows, parts=8, entries=16, rounds=6):
    """Everything against everything, in Python's whole numbers."""
    rows = [(i, [math.floor(SCALE * max(-MOST / SCALE, min(MOST / SCALE, c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not rows:
        return []
    at = cuts(len(rows[0][1]), parts)
    least = {}
    for i, v, _ in rows:
        least[i] = min(least.get(i, v), v)
    seeds = sorted(least.items())[:entries]
    books = [[v[a:b] for _, v in seeds] for a, b in zip(at, at[1:])]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    own = lambda x, book: min((far(x, y), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(at, at[1:])):
            met = {}
            for _, v, _ in rows:
                met.setdefault(own(v[a:b], books[k])[1], []).append(v[a:b])
            books[k] = [[sum(c) // len(met[e]) for c in zip(*met[e])] if e in met else x for e, x in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(c) for book in books for x in book for c in x).encode()).hexdigest()
    coded = [(i, label, [own(v[a:b], book) for (a, b), book in zip(zip(at, at[1:]), books)]) for i, v, label in rows]
    total = {}
    for _, label, c in coded:
        total[label] = total.get(label, 0) + sum(f for f, _ in c)
    return sorted((i, "".join(f"{e:02x}" for _, e in c), sum(f for f, _ in c), total[label], sha) for i, label, c in coded)


def found(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def test_kd_tree_finds_the_nearest_and_the_lowest_of_ties():
    rng = np.random.default_rng(0)
    for size, entries, spread in [(8, 16, 50), (2, 16, 3), (1, 7, 2), (3, 1, 5), (8, 200, 4), (2, 16, 1), (0, 3, 1)]:
        book, x = rng.integers(-spread, spread, (entries, size)), rng.integers(-spread - 1, spread + 1, (500, size))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = nearest(kd_tree(book), book, x)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


@pytest.mark.parametrize("n, size, spread", [(300, 16, 0.5), (120, 24, 0.003), (9, 8, 1.0), (60, 20, 3.0), (40, 3, 1.0)])
def test_against_brute_force(spark, n, size, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, spread, size)], [None, 0, 1, 7][i % 4]) for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(n // 3)]
    assert found(compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_odd_rows(spark):
    v = [0.1 * i for i in range(8)]
    bad = [(1, None, 0), (2, [*v[:7], None], 0), (3, [*v[:7], float("nan")], 1), (4, [*v[:7], float("inf")], 1), (5, v[:4], 1), (6, [], 1)]
    good = [(7, v, None), (7, v[::-1], 2), (7, v, None), (8, [-x for x in v], 2), (9, [0.0] * 8, 2), (10, [3e38] * 4 + [-3e38] * 4, 2)]
    data = spark.createDataFrame([(*r, "clash", 1) for r in bad + good], SCHEMA + ", code string, x int")
    f32 = [(i, [float(np.float32(c)) for c in x], label) for i, x, label in good]
    assert found(compress(data)) == brute(f32)
    assert compress(data.where("vec_id < 5")).count() == 0 and compress(data.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, v, 1), (None, v, None)], SCHEMA)
    assert compress(nulls).count() == 0 and compress(nulls.unionByName(spark.createDataFrame([(1, v, 1)], SCHEMA))).count() == 3


def test_codes_give_vectors_back(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, 8)], 0) for i in range(12)]
    data = spark.createDataFrame(rows, SCHEMA)
    books = fit(whole_vectors(data, "vec_id", "embedding", "label"), 8)
    back = {r.vec_id: r.vector for r in decoded(compress(data), books).collect()}
    assert all(abs(a - b) <= 1 / SCALE for i, v, _ in rows for a, b in zip(v, back[i]))


def test_sql(spark, sf):
    import duckdb

    from thicket.llm.queries import ORACLE, op12_vector_codes

    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
        rel = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLE['op12_vector_codes']})").fetchall()
    assert found(op12_vector_codes(spark, sf)) == sorted(rel)
