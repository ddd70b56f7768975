import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from thicket.llm.conversation_trie import conversation_trie, prefix_trie, rerooted, shared, turn_arrays

SCHEMA = "conv_id long, turn long, role string, text string"


def arrays_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}


def rebuilt(own):
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def brute(convs):
    """Every prefix a dict entry; subtrees by looking at all nodes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids, below = defaultdict(int), defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]] += 1
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    words = lambda k: len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below[k]), sum((len(members[x]) - 1) * words(x) for x in below[k]), sha))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=str)


def drawn(seed, convs, most, kinds, hot=0):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]) if kinds > 2 else "user", " ".join(["w"] * rng.randrange(kinds))) for c in range(convs) for t in range(rng.randrange(1, most))]
    rows += [(1000 + c, t, "user", "the same  words\there") for c in range(hot) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, most, kinds, hot, parts", [(1, 80, 6, 3, 0, 7), (2, 60, 9, 2, 60, 11), (3, 40, 30, 2, 0, 5), (4, 30, 4, 2, 300, 40), (5, 3, 3, 2, 0, 30)])
def test_nodes_are_those_of_brute_force(spark, seed, convs, most, kinds, hot, parts):
    rows = drawn(seed, convs, most, kinds, hot)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        arrays = turn_arrays(spark.createDataFrame(rows, SCHEMA))
        own = arrays_of(rows)
        assert found(prefix_trie(rerooted(arrays))) == brute(rebuilt(own))
        assert found(prefix_trie(arrays)) == brute(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    rows = [(20, None, None, None), (20, None, "user", ""), (20, 1, "user", "a"), (20, 1, "user", "a"), (21, 0, "", "é ü"), (None, 0, "user", "x"), (41, 3, "user", "b"), (-5, 0, "user", "n"), (22, 0, "user", "long " * 50_000)]
    data = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", key string, turns string")
    assert found(prefix_trie(rerooted(turn_arrays(data)))) == brute(rebuilt(arrays_of(rows)) | {-5: rebuilt_negative(rows)})
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in conversation_trie(data).collect()}
    own = arrays_of(rows)
    assert texts[-5, 0] == (None, None) and all(texts[c, d] == own[c][d - 1] for c, d in texts if d)


def rebuilt_negative(rows):
    """-5 - (-5) % 20 is 0 by SQL's remainder, and conversation 0 is absent."""
    return arrays_of(rows)[-5][zlib.crc32(b"-5") % 4 :]


def test_empty_table(spark):
    nodes = prefix_trie(rerooted(turn_arrays(spark.createDataFrame([], SCHEMA))))
    assert nodes.count() == 0 and dict(nodes.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}


def test_a_long_conversation_and_its_copies(spark):
    rows = [(c, t, "user", str(t)) for c in (40, 60, 80) for t in range(3000)]
    got = {r.depth: r for r in prefix_trie(turn_arrays(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == 3001 and all(r.n_convs == 3 and r.conv_id == 40 and r.n_leaves == 1 for r in got.values()) and got[0].saved_tokens == 6000


def test_shared_turns():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randbytes(1) * 16 if rng.random() < 0.2 else b"x" * 16 for _ in range(rng.randrange(6))] for _ in range(2))
        plain = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared(b"".join(a), b"".join(b)) == plain


def test_sql(spark, sf):
    import duckdb

    from thicket.llm.queries import ORACLE, op13_conversation_trie

    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
        rel = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op13_conversation_trie']})").fetchall()
    assert found(op13_conversation_trie(spark, sf)) == sorted(rel, key=str)
