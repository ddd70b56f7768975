"""The trie of conversations' prefixes.

A conversation is an array of turns, a turn a digest of 16 bytes of its role and text, so that a whole array is one
binary key. Keys are sorted globally by ranges. In each range one sweep over neighbouring keys takes the prefix that two
of them share, closes the open nodes beyond it and opens the new ones; its memory is the stack of open nodes. What a
range can't know alone are the nodes on the paths of its first and last key, which may reach into its neighbours: their
parts go to a second sweep, over one row a range, that stitches the stacks in the ranges' order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm._shared import broadcast_if, staged

#: Bytes of a turn's digest (the first half of its SHA-256).
WIDTH = 16
#: Nodes whose ids the last join sends to all tasks, at most.
SENT_NODES = 200_000

_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
NODE_DDL = "conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: What a range tells the second sweep: its first and last key, the depth to which all its keys agree, the nodes on the
#: first key's path and those on the last key's path below that depth, and the ids of the first and the last key.
_PART = pa.struct([("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("w", pa.int64()), ("ends", pa.string())])
_EDGE = pa.struct([("first", pa.binary()), ("last", pa.binary()), ("through", pa.int64()), ("left", pa.list_(_PART)), ("right", pa.list_(_PART)), ("first_ids", pa.binary()), ("last_ids", pa.binary())])
_PART_DDL = "array<struct<n:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,w:bigint,ends:string>>"
_EDGE_DDL = f"struct<first:binary,last:binary,through:bigint,left:{_PART_DDL},right:{_PART_DDL},first_ids:binary,last_ids:binary>"
# A node's parent is known, or it is the open node `lid` of range `part`.
_SWEPT = pa.schema([*_NODE, ("parent_conv_id", pa.int64()), ("part", pa.int64()), ("lid", pa.int64()), ("edge", _EDGE)])
_SWEPT_DDL = f"{NODE_DDL}, parent_conv_id bigint, part bigint, lid bigint, edge {_EDGE_DDL}"
# Stitched nodes are the open nodes `sid` of range -1. Rows without a depth say which of them a range's open node is.
_STITCHED = pa.schema([*_NODE, ("part", pa.int64()), ("lid", pa.int64()), ("sid", pa.int64())])
_STITCHED_DDL = f"{NODE_DDL}, part bigint, lid bigint, sid bigint"


def digest(role: Column, text: Column) -> Column:
    """32 hex digits that tell turns apart; null role or text is empty."""
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.coalesce(text.cast("string"), F.lit(""))), 256), 1, 2 * WIDTH)


def turn_arrays(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (d, w)) by turn, null first: d is a turn's digest(), w its words `[^\\x20\\x09-\\x0D]+`.

    Turns with one number are ordered by role, then by digest. Rows without an id are left out; repeated rows are
    repeated turns. What is gathered for a conversation is 16 bytes of digest and a word count a turn, not its texts.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.struct(F.col(turn_col).isNotNull().alias("given"), F.col(turn_col).alias("turn"), role.alias("role"), digest(role, F.col(text_col)).alias("d"), words.alias("w"))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rerooted(arrays: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """arrays with each conversation c's first h turns replaced by those of conversation c - c % every, where
    h = crc32(c as decimal text) % most. Where that one has fewer turns, all of them; where there is none, none.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = arrays.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = arrays.select("conv_id", "turns", base.alias("base"), h.alias("h"))
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common from their start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:  # low turns agree, high don't
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


class _Open:
    """A node of the stack: its members so far, the closed nodes below it, and those of them that wait for its id."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "w", "ends", "waiting", "sid")

    def __init__(self, w: int, sid: int = 0):
        self.n = self.children = self.leaves = self.saved = 0
        self.w, self.sid, self.least, self.ends, self.waiting = w, sid, None, None, []

    def members(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def ended(self, ids: bytes) -> None:
        """ids: decimal ids of members without a further turn, that follow those told before."""
        if self.ends is None:
            self.ends = hashlib.sha256(ids)
        else:
            self.ends.update(b"," + ids)

    def sha(self) -> str:
        return self.ends if isinstance(self.ends, str) else (self.ends or hashlib.sha256()).hexdigest()

    def closed(self, depth: int) -> tuple:
        """Its figures, once nothing can be added to it any more."""
        self.saved += (self.n - 1) * self.w
        self.leaves = self.leaves or 1
        return self.least, depth, self.n, self.children, self.leaves, self.saved, self.sha()

    def takes(self, child: _Open) -> None:
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def part(self) -> dict:
        return {k: getattr(self, k) for k in ("n", "least", "children", "leaves", "saved", "w")} | {"ends": self.sha()}


def _batches(rows: list[tuple], schema: pa.Schema):
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 10_000]), schema.types)], schema=schema)


def _sweep(batches):
    """Nodes of one range of sorted keys, and one row for the nodes on the paths of its first and last key.

    Open nodes of the first path are numbered by their depth, those of the last path alone by their depth below zero.
    """
    part, out = TaskContext.get().partitionId(), []
    left: list[_Open] = []
    stack: list[_Open] = []
    first = last = first_ids = None
    through, ids = 0, bytearray()  # ids: those of the key at hand

    def close(to: int) -> None:
        """Closes the nodes deeper than to: their parents are told, and those that aren't on the first path are done."""
        while len(stack) - 1 > to:
            depth, node = len(stack) - 1, stack.pop()
            parent = stack[-1]
            parent.members(node.n, node.least)
            if depth < len(left) and left[depth] is node:
                continue
            figures = node.closed(depth)
            out.extend((*x, node.least, None, None, None) for x in node.waiting)
            parent.takes(node)
            if depth <= len(left) and left[depth - 1] is parent:
                out.append((*figures, None, part, depth - 1, None))
            else:
                parent.waiting.append(figures)

    for b in batches:
        for conv, key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if key != last:
                common, size, words = -1, len(key) // WIDTH, words.as_py()
                if first is None:
                    first, through = key, size
                else:
                    if first_ids is None:
                        first_ids = bytes(ids)
                    else:
                        stack[-1].ended(ids)
                    common = shared(last, key)
                    through = min(through, common)
                    close(common)
                stack.extend(_Open(words[d - 1] if d else 0) for d in range(common + 1, size + 1))
                left, last, ids = left or list(stack), key, bytearray()
            stack[-1].members(1, conv)
            ids += b",%d" % conv if ids else b"%d" % conv
        if len(out) >= 10_000:
            yield from _batches(out, _SWEPT)
            out.clear()
    if first is None:
        return
    right = stack[through + 1 :]
    for depth, node in enumerate(right, through + 1):
        out.extend((*x, None, part, -depth, None) for x in node.waiting)
    for above, node in zip(stack[-2::-1], stack[::-1]):
        above.members(node.n, node.least)
    edge = {"first": first, "last": last, "through": through, "left": [x.part() for x in left], "right": [x.part() for x in right]}
    ids = bytes(ids)
    out.append((None,) * 8 + (part, None, edge | {"first_ids": ids if first_ids is None else first_ids, "last_ids": None if first_ids is None else ids},))
    yield from _batches(out, _SWEPT)


def _stitch(batches):
    """The nodes that are open at a range's edge: one row a range, in order, is put on the stack of those before it."""
    out: list[tuple] = []
    stack: list[_Open] = []
    last, named = None, 0

    def close(to: int) -> None:
        while len(stack) - 1 > to:
            depth, node = len(stack) - 1, stack.pop()
            figures = node.closed(depth)
            if stack:
                stack[-1].takes(node)
            out.append((*figures, -1, stack[-1].sid if stack else None, node.sid))

    def put(depth: int, part: int, lid: int, x: dict) -> None:
        """Adds a range's part x of the node at this depth of the stack, or opens the node with it."""
        nonlocal named
        if depth == len(stack):
            stack.append(_Open(x["w"], named))
            named += 1
        node = stack[depth]
        node.members(x["n"], x["least"])
        node.children, node.leaves, node.saved = node.children + x["children"], node.leaves + x["leaves"], node.saved + x["saved"]
        out.append((None,) * 7 + (part, lid, node.sid))

    for b in batches:
        for part, e in zip(b.column(0).to_pylist(), b.column(1)):
            e = e.as_py()
            if last is not None:
                close(shared(last, e["first"]))
            for depth, x in enumerate(e["left"]):
                put(depth, part, depth, x)
            stack[-1].ended(e["first_ids"])
            close(e["through"])
            for depth, x in enumerate(e["right"], e["through"] + 1):
                put(depth, part, -depth, x)
                stack[-1].ends = x["ends"]
            if e["right"]:
                stack[-1].ends = None
                stack[-1].ended(e["last_ids"])
            last = e["last"]
            yield from _batches(out, _STITCHED)
            out.clear()
    close(-1)
    yield from _batches(out, _STITCHED)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first d turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (all long) and ends_sha256, from the root (d = 0, parent_conv_id null) to whole conversations.

    arrays has conv_id and turns as turn_arrays() gives them; each row is a member, also where ids repeat or turns are
    empty. conv_id is the smallest member, n_convs the number of members, n_leaves the childless nodes of the subtree,
    saved_tokens the subtree's sum of (n_convs - 1) times the words of each node's last turn, ends_sha256 the SHA-256 of
    the comma-joined ids, in numeric order, of members that end there. Without rows there is no node.

    A conversation is one row of 16 bytes a turn; copies are told apart by id in the order, so no range gets them all.
    """
    turn = F.col("turns")
    key = F.unhex(F.array_join(F.transform(turn, lambda t: t["d"]), ""))
    keyed = arrays.select("conv_id", F.coalesce(key, F.unhex(F.lit(""))).alias("key"), F.transform(turn, lambda t: t["w"].cast("int")).alias("words"))
    ranged = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = staged(ranged.mapInArrow(_sweep, _SWEPT_DDL), "trie")
    edges = swept.where(F.col("edge").isNotNull()).select("part", "edge")
    stitched = staged(edges.repartition(1).sortWithinPartitions("part").mapInArrow(_stitch, _STITCHED_DDL), "stitched")
    own = stitched.where(F.col("depth").isNotNull())
    found = stitched.where(F.col("depth").isNull()).select("part", "lid", "sid").join(own.select("sid", F.col("conv_id").alias("above")), "sid")
    found = found.select("part", "lid", "above").unionByName(own.select(F.lit(-1).cast("long").alias("part"), F.col("sid").alias("lid"), F.col("conv_id").alias("above")))
    figures = [name for name, _ in _NODE]
    nodes = swept.where(F.col("depth").isNotNull()).select(*figures, "parent_conv_id", "part", "lid")
    nodes = nodes.unionByName(own.select(*figures, F.lit(None).cast("long").alias("parent_conv_id"), "part", "lid"))
    nodes = nodes.join(broadcast_if(found, stitched.count(), SENT_NODES), ["part", "lid"], "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *figures[2:])


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie() of conversations as they are, with role and text of each node's last turn (null at the root)."""
    nodes = prefix_trie(turn_arrays(conversations, conv_col, turn_col, role_col, text_col))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role, text)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", digest(F.col("role"), F.col("text")))
    turns = turns.withColumn("depth", F.row_number().over(order).cast("long")).drop("turn")
    return nodes.join(turns, ["conv_id", "depth"], "left")
