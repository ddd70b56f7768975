"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius, groups.

Two fingerprints within R bits agree on at least B - R of B bit blocks, so each fingerprint is dealt to the
C(B, R) shards of the block sets it could agree on; those shards are all that its radius can reach. Inside a shard
the search is by vantage points: the smallest fingerprint is the root, members within R of it are linked to it, and
members are cut by their distance to the root, where only annuli whose triangle bounds overlap (distances that differ
by R or less) are compared, each by a vantage-point tree of its own. Members that are already connected are not
compared again. Vantage points alone can't be the outer shards: 64-bit fingerprints lie 32 +- 4 bits from any point,
so a radius of 4 overlaps most annuli (README has the figures).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.persist import cut_and_told
from thicket.llm._shared import broadcast_if, staged

RADIUS, BLOCKS, SHINGLE, SEED = 4, 6, 4, 42
#: Fingerprints that one comparing step holds at a time.
BLOCK_ROWS = 2048
LEAF = 96
#: Edges that a task holds at a time where it makes stars of them.
AT_ONCE = 1 << 18
#: Nodes whose minima are broadcast at most, some megabytes.
BROADCAST_NODES = 50_000
#: Shards with more rows than HOT_ROWS are hot: what is known of them goes to their rows by a broadcast, of at most
#: BROADCAST_ROWS hot shards, so that no task gets all rows of one. Beyond that, Spark shuffles, and splits what is skewed.
HOT_ROWS, BROADCAST_ROWS = 256, 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles, in order; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, as an unsigned integer. Null and texts without words: 0."""
    return fingerprint_of(word_shingles(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingles' hashes: a bit is 1 if it is set in over half of them. Of none: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of docs; fp is the fingerprint as a signed bigint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits of every set of blocks - radius blocks, as signed 64-bit numbers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _stars(batches):
    """Edges (u, v) to stars: of AT_ONCE edges at a time, each node that has a smaller one in reach, with the smallest."""
    def star(part: list) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([x for b in part for x in (b.column(0), b.column(1))]), return_inverse=True)
        ends = np.split(at, np.cumsum([b.num_rows for b in part for _ in range(2)])[:-1])
        a, b = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
        up = np.arange(len(nodes))
        while ((x := up[a]) != (y := up[b])).any():
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up != up[up]).any():
                up = up[up]
        below = np.flatnonzero(up < np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[up[below]])], ["u", "v"])

    held: list = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield star(held)
            held = []
    if held:
        yield star(held)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Rounds of large-star and small-star until only stars are left;
    each task makes stars of the edges that it has at hand before they are dealt out.

    Only minima and maxima are taken at a node, never a list of its neighbours, so a node with many links needs no large
    row. In stars all nodes have either larger neighbours only, or one neighbour, a smaller one; how many don't is told as
    the minima are written, which in the last round are the result. Minima of up to BROADCAST_NODES nodes are broadcast.
    """
    def dealt(e: DataFrame) -> DataFrame:
        return staged(e.mapInArrow(_stars, "u bigint, v bigint").distinct(), "links")

    edges = dealt(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")))
    while True:
        both = edges.union(edges.select("v", "u"))
        ends = both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        open_ = (F.col("lo") < F.col("u")) & (F.col("lo") != F.col("hi"))
        least, told = cut_and_told(ends.select("u", F.least("lo", "u").alias("m"), open_.alias("open")), "least", F.count(F.lit(1)).alias("nodes"), F.count_if("open").alias("open"))
        if not told["open"]:
            return least.select(F.col("u").alias("node"), F.col("m").alias("comp"))
        large = both.where("v > u").join(broadcast_if(least, told["nodes"], BROADCAST_NODES), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(broadcast_if(least, told["nodes"], BROADCAST_NODES), "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = dealt(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v"))


class _Union:
    """Union-find over positions; starts from labels."""

    def __init__(self, labels: np.ndarray):
        self.up = np.unique(labels, return_inverse=True)[1] if len(labels) else np.zeros(0, np.int64)

    def join(self, i: int, j: int) -> bool:
        a, b = self.up[i], self.up[j]
        if a == b:
            return False
        self.up[self.up == max(a, b)] = min(a, b)
        return True


def _between(x: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, sets: _Union, out: list) -> None:
    """Links from left to right (positions in x) that join two sets."""
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = np.bitwise_count(x[rows][:, None] ^ x[right][None, :]) <= radius
        near &= sets.up[rows][:, None] != sets.up[right][None, :]
        while near.any():
            i, j = np.unravel_index(np.argmax(near), near.shape)
            sets.join(rows[i], right[j])
            out.append((rows[i], right[j]))
            near &= sets.up[rows][:, None] != sets.up[right][None, :]


def tree_links(x: np.ndarray, labels: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions) that connect what the radius connects, beyond what labels connect already.

    A vantage-point tree, walked as it is built: inside holds the points up to the median distance plus the radius,
    outside those beyond the median, so two points within the radius are together in one of them.
    """
    sets, out, todo = _Union(labels), [], [np.arange(len(x))]
    while todo:
        s = todo.pop()
        if len(s) < 2 or (sets.up[s] == sets.up[s[0]]).all():
            continue
        if len(s) <= LEAF:
            _between(x, s, s, radius, sets, out)
            continue
        d = np.bitwise_count(x[s] ^ x[s[0]])
        for j in s[1:][d[1:] <= radius]:
            if sets.join(s[0], j):
                out.append((s[0], j))
        rest, d = s[1:], d[1:].astype(np.int64)
        middle = int(np.median(d))
        inside, outside = rest[d <= middle + radius], rest[d > middle]
        if len(inside) + len(outside) > 1.8 * len(rest):
            _between(x, rest, rest, radius, sets, out)
        else:
            todo += [inside, outside]
    return out


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, g in pdf.groupby(["shard", "left", "right"], sort=False):
            x, comp, side = g["fp"].to_numpy().view(np.uint64), g["comp"].to_numpy(), g["side"].to_numpy()
            if (side == 0).all():
                links = tree_links(x, comp, radius)
            else:
                links = []
                _between(x, np.flatnonzero(side == 1), np.flatnonzero(side == 2), radius, _Union(comp), links)
            fp = g["fp"].to_numpy()
            found += [(int(fp[i]), int(fp[j])) for i, j in links]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with facts, which has a row for each of keys and its number of rows n. Hot keys are not dealt by key."""
    hot, told = cut_and_told(facts.where(F.col("n") > HOT_ROWS), "hot", F.count(F.lit(1)).alias("rows"))
    if not 0 < told["rows"] <= BROADCAST_ROWS:
        return rows.join(facts, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col("n") <= HOT_ROWS), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def near_links(uniq: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly what the radius connects."""
    masks = [F.struct(F.lit(i).cast("byte").alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for i, m in enumerate(block_masks(radius, blocks))]
    rows = uniq.select("fp", F.explode(F.array(*masks)).alias("k")).select("fp", "k.combo", "k.val")
    facts = staged(rows.groupBy("combo", "val").agg(F.min("fp").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1"), "facts")
    rows = _with_facts(rows, facts, ["combo", "val"]).select("combo", "val", "fp", "root", "n", _apart(F.col("fp"), F.col("root")).alias("r"))
    rows = staged(rows, "shards")
    near = rows.where((F.col("fp") != F.col("root")) & (F.col("r") <= radius))
    links = staged(near.select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct(), "rootlinks")
    # The root has been compared with every member. What is left: members that the links so far don't connect.
    comps = connected(links)
    open_ = rows.where("n > 2 and fp <> root").join(comps, F.col("fp") == F.col("node"), "left")
    open_ = staged(open_.select("combo", "val", "fp", "n", "r", F.coalesce("comp", "fp").alias("comp")), "members")
    apart = open_.groupBy("combo", "val").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    open_, told = cut_and_told(_with_facts(open_.drop("n"), apart.select("combo", "val", "n"), ["combo", "val"]), "open", F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"))
    if not (left := told["rows"]):
        return links
    # Small shards are compared whole; they share a call, so that a call has some thousands of rows.
    shard = F.xxhash64("combo", "val")
    none = F.lit(0).cast("long")
    small = open_.where(F.col("n") <= BLOCK_ROWS).select(
        shard.alias("shard"), none.alias("left"), none.alias("right"), F.lit(0).alias("side"), "fp", "comp", F.pmod(shard, F.lit(max(16, left // 20_000))).alias("call")
    )
    work = small.unionByName(_large_shards(open_.where(F.col("n") > BLOCK_ROWS), radius)) if told["most"] > BLOCK_ROWS else small
    more = work.groupBy("call").applyInPandas(_compare(radius), "a bigint, b bigint")
    return links.union(staged(more, "treelinks"))


def _large_shards(members: DataFrame, radius: int) -> DataFrame:
    """(shard, left, right, side, fp, comp, call): the pairs of blocks of large shards that are to be compared, a call each.

    A ring holds the members at one distance r from the root; it is cut to blocks of about BLOCK_ROWS. Rings whose
    distances differ by more than the radius hold no pair within it.
    """
    rings, n_rings = cut_and_told(members.groupBy("combo", "val", "r").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("subs")), "rings", F.count(F.lit(1)).alias("rows"))
    parts = rings.select("combo", "val", "r", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    parts = parts.select("combo", "val", F.struct("r", "sub").alias("part"))
    one, two = parts.withColumnRenamed("part", "left"), parts.withColumnRenamed("part", "right")
    pairs = one.join(two, ["combo", "val"]).where((F.col("left") <= F.col("right")) & (F.col("right.r") - F.col("left.r") <= radius))
    side = lambda part, n: F.struct(F.col(part).alias("part"), F.lit(n).alias("side"))
    sides = F.when(F.col("left") == F.col("right"), F.array(side("left", 0))).otherwise(F.array(side("left", 1), side("right", 2)))
    pairs = pairs.select("combo", "val", "left", "right", F.explode(sides).alias("s")).select("combo", "val", F.xxhash64("left").alias("left"), F.xxhash64("right").alias("right"), "s.part", "s.side")
    pairs, n_pairs = cut_and_told(pairs, "pairs", F.count(F.lit(1)).alias("rows"))
    member = members.join(broadcast_if(rings, n_rings["rows"], BROADCAST_ROWS), ["combo", "val", "r"])
    member = member.select("combo", "val", "fp", "comp", F.struct("r", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int").alias("sub")).alias("part"))
    work = member.join(broadcast_if(pairs, n_pairs["rows"], BROADCAST_ROWS), ["combo", "val", "part"])
    shard = F.xxhash64("combo", "val")
    return work.select(shard.alias("shard"), "left", "right", "side", "fp", "comp", F.xxhash64(shard, "left", "right").alias("call"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each row of docs, repeated rows included.

    fingerprint is 16 hex digits; component_id the smallest id whose fingerprint is reachable by links of at most
    radius bits. Null and wordless texts have fingerprint 0 and are linked like any other. A null id never names a
    group; a group without any id has a null component_id. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "simhash")
    uniq = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "uniq")
    comps = connected(near_links(uniq, radius, blocks))
    groups = uniq.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    names = groups.groupBy("comp").agg(F.min("first").alias("component_id"))
    # What a fingerprint's group is called is joined by fingerprint; AQE splits the one that many copies share.
    named = groups.join(names, "comp").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays (one row, if that id repeats).

    Rows whose id is null take no part and stay.
    """
    return without_copies(docs, simhash_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col), id_col)


def without_copies(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows that groups (id_col, component_id) puts under another id, and without repeated ids."""
    groups = staged(groups.select(id_col, "component_id"), "groups")
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    out = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    n, distinct = groups.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col))).first()
    if n == distinct:
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(out.where(F.col(id_col).isNull()))
