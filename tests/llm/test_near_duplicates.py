import random

import numpy as np
import pytest
import xxhash

from thicket.llm.simhash import RADIUS, block_masks, connected, fingerprint, fingerprints, keep_one_each, near_links, simhash_groups, tree_links


def plain_fingerprint(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(points: list[int], radius: int = RADIUS) -> list[int]:
    up = list(range(len(points)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(points))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two three", "A b c d", "a b c d e f g " * 50, "É é x   y", "x" * 9000 + " y" * 3, "w" + " w" * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42) == fingerprint("A B C D")


def test_masks_cover_every_pair():
    masks, rng = [m % 2**64 for m in block_masks()], random.Random(1)
    assert len(masks) == 15
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("seed,spread,n", [(1, 3, 400), (2, 6, 700), (3, 12, 300), (4, 1, 60)])
def test_tree_links_connect_what_the_radius_does(seed, spread, n):
    rng = random.Random(seed)
    centre = [rng.getrandbits(64) for _ in range(3)]
    points = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))) for c in centre for _ in range(n)})
    x = np.array(points, np.uint64)
    links = tree_links(x, np.arange(len(x)))
    assert all((points[i] ^ points[j]).bit_count() <= RADIUS for i, j in links)
    up = list(range(len(points)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        up[b] = a
    want = plain_groups(points)
    assert len({top(i) for i in range(len(points))}) == len(set(want))


def test_links_of_a_large_shard(spark):
    """Thousands of fingerprints around one point: blocks, rings and trees, against brute force."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(22), rng.randrange(9))) for _ in range(5000)} | {rng.getrandbits(64) for _ in range(200)}
    points |= {p ^ (0b111 << 40) for p in list(points)[:40]}
    ids = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in ids]
    links = connected(near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    got = dict(zip(signed, signed)) | {r.node: r.comp for r in links}
    x = np.array(ids, np.uint64)
    want = np.arange(len(ids))
    todo, seen = list(range(len(ids))), np.zeros(len(ids), bool)
    for i in todo:
        if not seen[i]:
            stack, seen[i] = [i], True
            while stack:
                j = stack.pop()
                want[j] = i
                new = np.flatnonzero((np.bitwise_count(x ^ x[j]) <= RADIUS) & ~seen)
                seen[new] = True
                stack += new.tolist()
    groups: dict = {}
    for i, s in enumerate(signed):
        groups.setdefault(want[i], set()).add(got[s])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_hot_shards_by_broadcast_or_shuffle(spark, monkeypatch):
    from thicket.llm import simhash

    rng = random.Random(8)
    centre = rng.getrandbits(63)
    points = sorted({centre ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(10))) for _ in range(900)})
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 128)
    for most in (500_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        got = dict(zip(points, points)) | {r.node: r.comp for r in connected(near_links(spark.createDataFrame([(p,) for p in points], "fp long"))).collect()}
        want = plain_groups(points)
        groups: dict = {}
        for p, w in zip(points, want):
            groups.setdefault(w, set()).add(got[p])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_groups_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").withColumnRenamed("lang", "fp")
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, " \t", None), (-1, None, "x"), (None, "alone in its group by far", "x"), (None, None, "x")], "doc_id long, text string, fp string")
    docs = docs.unionByName(extra)
    rows = docs.collect()
    points = [plain_fingerprint(r.text) for r in rows]
    want = plain_groups(points)
    least: dict = {}
    for r, g in zip(rows, want):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expect = sorted((str(r.doc_id), f"{p:016x}", str(least.get(g))) for r, p, g in zip(rows, points, want))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_groups(docs).collect()) == expect


def test_one_of_each_stays(spark):
    a, b = "the same words in the same order over and over", "quite another text about something else entirely"
    rows = [(3, a), (1, a), (2, b), (2, b), (None, a), (5, None), (4, "")]
    got = keep_one_each(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _gone string, component_id string")).collect()
    assert {tuple(r)[2:] for r in got} == {("x", "y")}
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "4", "None"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(none).count() == 0 and keep_one_each(none).count() == 0 and fingerprints(none).count() == 0


def five_word_groups(texts):
    """Smallest position that pairs of 5-word similarity 0.8 or more connect, by brute force over the texts' sets."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up, where = list(range(len(texts))), {}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        a, b = sorted((top(i), top(j)))
        up[b] = a

    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty:
        join(empty[0], i)
    for i, s in enumerate(sets):
        shared: dict = {}
        for x in s:
            for j in where.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            where[x].append(i)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                join(i, j)
    return [top(i) for i in range(len(texts))]


def test_the_stage_keeps_one_at_five_words_and_four_fifths(spark):
    from corpus_pipeline import near_duplicates

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for edits in (0, 4, 5, 6, 7, 9, 12):  # similarities from about 0.88 to about 0.67
            near = list(words)
            for at in rng.sample(range(300), edits):
                near[at] = "x" + near[at]
            texts.append(" ".join(near))
    texts += ["a b c d e f g h i", "A b c d e f g h i", "a b c d e f g h j", "one", "ONE", "two words", "", " \t"]
    # Of a text's many copies hardly two are alike, but each is like the text.
    words = [f"v{i}" for i in range(400)]
    texts += [" ".join("y" + w if i in at else w for i, w in enumerate(words)) for at in [[], *(rng.sample(range(400), 8) for _ in range(150))]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(set(five_word_groups(texts)))
    assert sorted(r.doc_id for r in near_duplicates(spark, docs, "").collect()) == want
    assert sorted(r.doc_id for r in keep_one_each(docs).collect()) != want


def test_the_stage_on_the_documents(spark, sf):
    from corpus_pipeline import near_duplicates

    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = sorted({rows[i].doc_id for i in five_word_groups([r.text for r in rows])})
    got = sorted(r.doc_id for r in near_duplicates(spark, docs, sf).collect())
    assert got == want


def test_the_stage_without_ids_and_texts(spark):
    from thicket.llm.minhash import keep_one_alike

    a, b = "the same words in the same order over and over", "quite another text about something else entirely"
    rows = [(3, a), (1, a), (2, b), (2, b), (None, a), (5, None), (4, "")]
    got = keep_one_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "4", "None"]


def test_parts_of_long_texts_rule_out_no_pair(spark):
    """Parts at different levels against whole sets: what is alike is never ruled out, what is far from it is."""
    from thicket.llm.minhash import PART, _may_be_alike, _parts

    rng, sets, alike = np.random.default_rng(5), [], []
    for n in (1, 3, 300, 512, 513, 900, 1100, 5000, 40_000):
        base = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        more = rng.integers(-(1 << 63), (1 << 63) - 1, n // 2)
        sets += [base, np.concatenate([base, more[: n // 5]]), np.concatenate([base[n // 2 :], more])]
    rows = [(i, [int(x) for x in s]) for i, s in enumerate(sets)]
    got = {r.u: (np.unique(np.array(r.part, np.int32)), r.level) for r in _parts(spark.createDataFrame(rows, "u long, set array<long>")).collect()}
    assert all(len(part) <= 1.3 * PART and (level or len(part) == len(sets[u])) for u, (part, level) in got.items())
    assert len({level for _, level in got.values()}) > 3
    for u in range(0, len(sets), 3):
        judge = lambda v: _may_be_alike(got[u][0], got[v][0], got[u][1], got[v][1], 0.8)  # noqa: B023, E731
        alike.append((judge(u + 1), judge(u + 2) and len(sets[u]) > 1))
    assert alike == [(True, False)] * len(alike)


def test_simhash_proposes_pairs_of_the_pipelines_stage(spark, monkeypatch):
    """Without any bucket of minima, near copies are found by their fingerprints, and held against their shingles."""
    from pyspark.sql import functions as F

    from thicket.llm import minhash

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    one, near = " ".join(words), " ".join([*words[:300], "other", *words[301:]])
    assert (fingerprint(one, 5) ^ fingerprint(near, 5)).bit_count() <= RADIUS
    # Fingerprints of texts that repeat one shingle most of the time are the same, whatever else they hold.
    loops = ["a b c d e " * 40 + " ".join(f"{x}{i}" for i in range(60)) for x in "xy"]
    assert fingerprint(loops[0], 5) == fingerprint(loops[1], 5)
    sketches = minhash._sketches
    monkeypatch.setattr(minhash, "_sketches", lambda *x: sketches(*x).withColumn("keys", F.array("u")))
    docs = spark.createDataFrame(list(enumerate([one, near, *loops, " ".join(words[::-1])])), "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.keep_one_alike(docs).collect()) == [0, 2, 3, 4]


def test_components_take_few_tasks(spark):
    """Graphs with stars, chains, rings and scattered links, against brute force; what the driver keeps of a run is a few
    rounds' tasks."""
    from thicket.llm import simhash

    rng = random.Random(11)
    star, chain = [(5, 1000 + i) for i in range(500)], [(2000 + i, 2001 + i) for i in range(300)]
    ring = [(3000 + i, 3000 + (i + 1) % 97) for i in range(97)]
    loose = [tuple(rng.sample(range(5000, 6000), 2)) for _ in range(700)]
    edges = star + [(b, a) for a, b in chain] + ring + loose + [(7, 7), (1003, 2100), (1003, 2100)]
    rng.shuffle(edges)
    up = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    want = {n: top(n) for n in up}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    for at_once in (simhash.AT_ONCE, 1):  # whole tasks, and batch by batch
        sc.setJobGroup(f"components {at_once}", "")
        try:
            simhash.AT_ONCE, usual = at_once, simhash.AT_ONCE
            rows = connected(df).collect()
        finally:
            simhash.AT_ONCE = usual
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == len(want) and {r.node: r.comp for r in rows} == want
        jobs = tracker.getJobIdsForGroup(f"components {at_once}")
        assert len(jobs) <= 20
    assert connected(df.limit(0)).collect() == []


def test_staged_rows_leave_no_mark(spark):
    from pathlib import Path

    from thicket.functions.persist import cut

    out = cut(spark.range(10).repartition(2), "mark")
    assert out.count() == 10 and not list(Path(out.inputFiles()[0].removeprefix("file:")).parent.glob("*SUCCESS*"))


#: Texts of 9 shingles, 8 of 10 in common, that agree in no band of minima and whose fingerprints are 9 bits apart.
MISSED = [" ".join([*(f"w0x{i}" for i in range(12)), last]) for last in ("v2914", "v1881")]


def test_pairs_that_sketches_miss_are_found(spark):
    from thicket.llm import minhash

    a, b = (minhash.shingles(t) for t in MISSED)
    assert (len(np.intersect1d(a, b)), len(np.union1d(a, b))) == (8, 10) and (fingerprint(MISSED[0], 5) ^ fingerprint(MISSED[1], 5)).bit_count() > RADIUS
    assert not (minhash.minima(a) == minhash.minima(b)).reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any()
    docs = spark.createDataFrame([(1, MISSED[0]), (2, MISSED[1]), (3, "nothing like them in any of its words"), (4, MISSED[1])], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.keep_one_alike(docs).collect()) == [1, 3]


@pytest.mark.parametrize("common", [0, 3, 60])
def test_without_sketches_the_first_shingles_find_every_pair(spark, monkeypatch, common):
    """Texts of 1 to 400 words, copies of which up to a third of the words are changed, one passage in all of them, against
    brute force; whatever the order of the shingles."""
    from pyspark.sql import functions as F

    from thicket.llm import minhash

    rng = random.Random(common)
    passage, texts = [f"p{i}" for i in range(common)], []
    for n in (1, 4, 5, 6, 9, 14, 30, 31, 36, 60, 150, 400):
        base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.3):
            at = rng.randrange(n + 1)
            words = [w if rng.random() >= share else f"c{rng.randrange(10**6)}" for w in base]
            texts.append(" ".join([*words[:at], *passage, *words[at:]]))
            texts.append(" ".join([*words, *passage][rng.randrange(3) :]))
    sketches = minhash._sketches
    monkeypatch.setattr(minhash, "_sketches", lambda *x: sketches(*x).withColumns({"keys": F.array("u"), "fp": F.xxhash64("u")}))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in minhash.keep_one_alike(docs).collect())
    assert got == sorted(set(five_word_groups(texts))) and len(got) < len(texts) - 12
