"""Token-id files: raw id payloads with a minimal perfect hash index for keyed access.

A shard file has, in this order, all numbers little-endian: the magic b"THKTOK2\\n"; the header's length (uint32) and
the header (JSON: width in bytes of an id, number of documents and ids, bits of each level of the hash, where each part
ends); for each level its bit array, in blocks of 512 bits, and the number of bits set before each block (uint32); for
each slot of the hash a fingerprint of its key (uint32) and its document's number in the shard (uint32); for each
document, in order, where its ids begin (uint64, one more for the end); the keys, in order, a line each (JSON); the ids,
document by document. A folder of shards has a manifest (Parquet, in _manifest): the shards in order, with their first keys.

A key is a document's id and its occurrence in the shard (0 but for repeated ids). Looking one up reads a block of bits
and its rank at each level until a bit is set, and compares the fingerprint: constant time, some hundred bytes, whatever
the size of the shard. A foreign key is told with all but a chance of 2**-32. TokenFolder finds the shard by the manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thicket.llm._shared import fresh_path, no_cycles, staged

MAGIC = b"THKTOK2\n"
#: Bytes of ids after which a shard is closed, units that a worker remembers, bytes of text encoded at a time.
SHARD_BYTES, MEMO_UNITS, SLICE_BYTES = 16_000_000, 800_000, 2_000_000
GAMMA, LEVELS = 1.5, 64
#: Bits of a level that share a stored rank.
BLOCK = 512
#: The manifest's name in its folder; shards that a TokenFolder holds open.
MANIFEST, OPEN_SHARDS = "_manifest", 64


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def key_hash(key: object, occurrence: int) -> int:
    return xxhash.xxh64_intdigest(f"{key if type(key) is int else json.dumps(key)}#{occurrence}")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A multiplicative mix of 64-bit hashes with a seed."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def build_levels(h: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (as booleans): a key's slot is the rank of its bit on the first level where it is alone."""
    levels: list[np.ndarray] = []
    while len(h):
        if len(levels) == LEVELS:
            raise ValueError("two keys have one hash")
        at = (_mixed(h, len(levels)) % np.uint64(max(1, int(GAMMA * len(h))))).astype(np.int64)
        alone = np.bincount(at, minlength=max(1, int(GAMMA * len(h)))) == 1
        levels.append(alone)
        h = h[~alone[at]]
    return levels


def packed(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A level's bits in whole blocks (a row of bytes each), and the number of bits set before each block."""
    bits = np.packbits(np.pad(level, (0, -len(level) % BLOCK)), bitorder="little").reshape(-1, BLOCK // 8)
    counts = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return bits, (np.cumsum(counts) - counts).astype("<u4")


def bit_and_rank(blocks: np.ndarray, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether bit at is set, and how many are set before it; blocks and before are those of each at."""
    byte, bit = at % BLOCK >> 3, (at & 7).astype(np.uint8)
    own = blocks[np.arange(len(at)), byte]
    counts = np.bitwise_count(blocks).astype(np.int64)
    ahead = (np.cumsum(counts, axis=1) - counts)[np.arange(len(at)), byte]
    return (own >> bit & 1).astype(bool), before.astype(np.int64) + ahead + np.bitwise_count(own & ((np.uint8(1) << bit) - np.uint8(1)))


def slots(h: np.ndarray, sizes: list[int], fetch) -> np.ndarray:
    """The slot of each hash; -1 for what no level has. sizes: the levels' bits; fetch(level, block numbers) gives the
    blocks and their ranks, and the bits set in the whole level."""
    out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for k, size in enumerate(sizes):
        if not len(todo):
            break
        at = (_mixed(h[todo], k) % np.uint64(size)).astype(np.int64)
        left = []
        for a in range(0, len(todo), 8192):
            some, places = todo[a : a + 8192], at[a : a + 8192]
            blocks, before, total = fetch(k, places // BLOCK)
            hit, rank = bit_and_rank(blocks, before, places)
            out[some[hit]] = base + rank[hit]
            left.append(some[~hit])
        base += total
        todo = np.concatenate(left)
    return out


# --- files ----------------------------------------------------------------------------------------------------------


def _place(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path.replace("s3a://", "s3://", 1)))
    return fs.LocalFileSystem(), path


def shard_bytes(keys: list, ids: list[bytes], width: int) -> bytes:
    """A shard of documents in order: their keys and their ids as raw bytes."""
    seen: dict = {}
    named = []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        named.append((k, seen[k]))
    h = np.array([key_hash(*k) for k in named], np.uint64)
    levels = build_levels(h)
    index = [packed(x) for x in levels]
    totals = [int(x.sum()) for x in levels]
    at = slots(h, [len(x) for x in levels], lambda k, b: (index[k][0][b], index[k][1][b], totals[k]))
    marks, number = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u4")
    marks[at], number[at] = (h >> np.uint64(32)).astype("<u4"), np.arange(len(h))
    begins = np.concatenate(([0], np.cumsum([len(x) // width for x in ids]))).astype("<u8")
    parts = [p.tobytes() for bits_ranks in index for p in bits_ranks]
    parts += [marks.tobytes(), number.tobytes(), begins.tobytes(), "\n".join(json.dumps(k) for k in keys).encode(), b"".join(ids)]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    head = json.dumps({"width": width, "docs": len(keys), "ids": int(begins[-1]), "levels": [len(x) for x in levels], "set": totals, "parts": ends}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class Shard:
    """A shard, by a function that reads a range of its bytes; only the header is read at first."""

    def __init__(self, read):
        """read(start, length) gives bytes."""
        start = read(0, 12)
        if start[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        (n,) = struct.unpack_from("<I", start, 8)
        self.read, self.head = read, json.loads(read(12, n))
        ends = [12 + n + e for e in self.head["parts"]]
        self.parts = list(zip([12 + n, *ends], ends))
        self.marks, self.number, self.begins, self.names, self.ids = self.parts[2 * len(self.head["levels"]) :]
        self.kind = np.dtype("<u2" if self.head["width"] == 2 else "<u4")

    def whole(self, part: tuple[int, int], kind) -> np.ndarray:
        return np.frombuffer(self.read(part[0], part[1] - part[0]), kind)

    def items(self, part: tuple[int, int], at: np.ndarray, kind, width: int = 1) -> np.ndarray:
        """Items at some places of a part, width numbers each. Of many places the whole part is read."""
        size = np.dtype(kind).itemsize * width
        if len(at) > 64:
            return self.whole(part, kind).reshape(-1, width)[at]
        return np.stack([np.frombuffer(self.read(part[0] + int(a) * size, size), kind) for a in at]) if len(at) else np.zeros((0, width), kind)

    def _fetch(self, level: int, blocks: np.ndarray):
        bits, ranks = self.parts[2 * level : 2 * level + 2]
        return self.items(bits, blocks, np.uint8, BLOCK // 8), self.items(ranks, blocks, "<u4")[:, 0], self.head["set"][level]

    def find(self, keys: list[tuple[object, int]]) -> np.ndarray:
        """The number in the shard of each (id, occurrence); -1 for those it doesn't have."""
        h = np.array([key_hash(*k) for k in keys], np.uint64)
        at = slots(h, self.head["levels"], self._fetch)
        out, known = np.full(len(h), -1, np.int64), np.flatnonzero(at >= 0)
        same = self.items(self.marks, at[known], "<u4")[:, 0] == (h[known] >> np.uint64(32)).astype("<u4")
        known = known[same]
        out[known] = self.items(self.number, at[known], "<u4")[:, 0]
        return out

    def ids_of(self, key: object, occurrence: int = 0) -> np.ndarray | None:
        i = int(self.find([(key, occurrence)])[0])
        if i < 0:
            return None
        a, b = np.frombuffer(self.read(self.begins[0] + 8 * i, 16), "<u8").astype(int).tolist()
        width = self.kind.itemsize
        return np.frombuffer(self.read(self.ids[0] + a * width, (b - a) * width), self.kind)

    def keys(self) -> list:
        text = self.read(self.names[0], self.names[1] - self.names[0])
        return [json.loads(x) for x in text.split(b"\n")] if self.head["docs"] else []


def shard_of(data: bytes) -> Shard:
    """A shard whose bytes are in memory."""
    return Shard(lambda start, length: data[start : start + length])


def read_shard(path: str) -> Shard:
    """A shard file, read as a whole."""
    place, name = _place(path)
    with place.open_input_file(name) as f:
        return shard_of(f.read())


def open_shard(path: str) -> Shard:
    """A shard file of which each lookup reads what it needs."""
    place, name = _place(path)
    file = place.open_input_file(name)
    return Shard(lambda start, length: file.read_at(length, start))


class TokenFolder:
    """Keyed access to a folder of shards, in any later session: the manifest tells the shard, its hash the place."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        place, name = _place(f"{folder}/{MANIFEST}")
        rows = sorted(pq.read_table(name, filesystem=place).to_pylist(), key=lambda r: r["shard"])
        self.paths, self.firsts = [r["path"] for r in rows], [(r["first"] is not None, r["first"]) for r in rows]
        self.shards: dict[str, Shard] = {}

    def ids_of(self, key: object, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document; of those with one id, in order. None for a key that no shard has."""
        mark = (key is not None, key)
        last = bisect_right(self.firsts, mark) - 1 if key is not None else sum(not known for known, _ in self.firsts)
        at = max(0, bisect_left(self.firsts, mark) - 1) if key is not None else 0
        while at <= min(last, len(self.paths) - 1):
            if self.paths[at] not in self.shards:
                if len(self.shards) >= OPEN_SHARDS:
                    self.shards.clear()
                self.shards[self.paths[at]] = open_shard(self.paths[at])
            shard, n = self.shards[self.paths[at]], 0
            while (ids := shard.ids_of(key, n)) is not None:
                if not occurrence:
                    return ids
                occurrence, n = occurrence - 1, n + 1
            at += 1
        return None


# --- encoding -------------------------------------------------------------------------------------------------------

#: White space next to a space, or other than a space and a line end: such texts are encoded as a whole.
_ASCII_UNEVEN = ["  ", "\n ", " \n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_UNEVEN = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Latin letters; what is at the end of a unit of them, one mark, is a piece of its own.
_LETTERS = r"[A-Za-zªµºÀ-ÖØ-öø-\u024f]"
_WORD, _MARKED = re.compile(rf"\n?{_LETTERS}+").fullmatch, re.compile(r"[0-9A-Za-zªµºÀ-ÖØ-öø-\u024f][.,;:!?]")
#: Byte-level tokenizers write these bytes as other characters; the rest of Latin-1 as itself. A space stays, here.
_AS_CHARS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, each distinct unit once a slice.

    A unit is a space and what follows it up to the next space or line end, or a line end and what follows it. Byte-level
    tokenizers begin a new piece at a space that stands before anything but white space, and a lone line end is a piece, so
    units have the ids they have in the text. Texts where line ends stand together as one piece are cut at spaces only; texts
    where white space stands together otherwise, or is of a rarer kind, are encoded as a whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if max(size, (end_id or 0) + 1) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.met = np.zeros(1 << 25, bool)  # hashes of the units met so far
        # For units of plain letters, which are one piece each: the same model, given the pieces as it writes them.
        self.simple = Tokenizer(self.tokenizer.model)
        self.simple.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        one = lambda text: self.whole([text])[0]
        self.marks = {m: one(m) for m in ".,;:!?" if one(f" ab{m}") == one(" ab") + one(m) and one(f" a1{m}") == one(" a1") + one(m)}
        self.line = one("\n")
        self.memo: dict[str, bytes] = {"": b"", "\n": self.line}  # of units without their space
        spec = json.loads(self.tokenizer.to_str())
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_units = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and spec.get("normalizer") is None
        # Two line ends or more are one piece before the end, an added token or another line end.
        self.by_lines = len(self.line) == self.width and not any("\n" in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        self.joined_lines = ["\n\n\n", *("\n\n" + a["content"] for a in added)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: list[str], out: dict[str, bytes], letters: bool, lines: bool) -> None:
        """Adds the units' ids to out: one call for many units, whose bytes tell where each ends. letters: units of letters
        only; lines: units that begin with a line end, not with a space that is left out here."""
        for at in range(0, len(units), 5000):
            some = units[at : at + 5000]
            text = "".join(some) if lines else " " + " ".join(some)
            sizes = np.fromiter(map(len, some if text.isascii() else map(str.encode, some)), np.int64, len(some)) + (not lines)
            if letters:
                text = (text[1:] if text.isascii() else text[1:].encode().decode("latin-1")).replace("\n", " ")
                text = text.translate(_AS_CHARS) if not text.isascii() else text
                text = text if lines else "Ġ" + text.replace(" ", " Ġ")
            ids = np.array((self.simple if letters else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends, stops = np.cumsum(self.lengths[ids]), np.cumsum(sizes - (letters and lines))
            cut = np.searchsorted(ends, stops)
            if cut[-1] < len(ends) and (ends[cut] == stops).all():
                raw, cut = ids.astype(self.kind).tobytes(), ((cut + 1) * self.width).tolist()
                head = self.line if letters and lines else b""
                out.update(zip(some, [head + raw[a:b] for a, b in zip([0, *cut], cut)]))
            else:
                out.update(zip(some, self.whole(some if lines else [" " + u for u in some])))

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of units (without their space) that aren't known. Those met for the second time are remembered: most
        of a language's words are met once. A mark at a unit's end is a piece of its own."""
        memo, marks, out = self.memo, self.marks, {}
        if len(memo) > MEMO_UNITS:
            memo.clear()
            memo.update({"": b"", "\n": self.line})
            if self.met.mean() > 0.5:
                self.met[:] = False
        marked = [u for u in new if u[-1] in marks and _MARKED.fullmatch(u, max(0, len(u) - 2))]
        new.difference_update(marked)
        for u in marked:
            if (base := memo.get(u[:-1])) is not None:
                out[u] = base + marks[u[-1]]
            else:
                new.add(u[:-1])
        words = set(filter(_WORD, new))
        plain = set(filter(str.isascii, words))
        for some, letters in ((plain, True), (words - plain, True), (new - words, False)):
            lines = [u for u in some if u[0] == "\n"]
            self._together(lines, out, letters, True)
            self._together(list(some.difference(lines)), out, letters, False)
        for u in marked:
            if u not in out:
                out[u] = out[u[:-1]] + marks[u[-1]]
        found = list(out)
        places = np.fromiter(map(hash, found), np.int64, len(found)) & (len(self.met) - 1)
        memo.update([(u, out[u]) for u, twice in zip(found, self.met[places].tolist()) if twice])
        self.met[places] = True
        return out

    def _by_units(self, rests: list[str]) -> tuple[memoryview, list[int]]:
        """The ids of all units of texts, and the bytes where each text's begin (one more for the end)."""
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        distinct = split.values.dictionary_encode()
        units, at = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()
        found = list(map(self.memo.get, units))
        if new := {u for u, x in zip(units, found) if x is None}:
            fresh = self._learn(new)
            found = [fresh[u] if x is None else x for u, x in zip(units, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        begins = np.cumsum(sizes) - sizes
        places = np.repeat(begins[at] - ends[:-1], sizes[at])
        places += np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), self.kind)[places]
        return memoryview(ids.tobytes()), (ends[split.offsets.to_numpy()] * self.width).tolist()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id, as raw bytes. Null is the empty text."""
        kinds, uneven, firsts, rests = [], [], [], []
        for t in texts:
            if not t:
                kinds.append(None)
            elif not self.by_units or t[0] == " " or t[-1] == " " or any(map(t.__contains__, _ASCII_UNEVEN)) or not t.isascii() and _UNEVEN.search(t):
                kinds.append(False)
                uneven.append(t)
            else:
                if self.by_lines and "\n" in t and not ("\n\n" in t and (t.endswith("\n\n") or any(map(t.__contains__, self.joined_lines)))):
                    t = t.replace("\n", " \n")
                first, _, rest = t.partition(" ")
                kinds.append(True)
                firsts.append(first)
                rests.append(rest)
        whole = iter(self.whole(uneven))
        if rests:
            ids, ends = self._by_units(rests)
            units = (b"".join((first, ids[a:b], self.end)) for first, a, b in zip(self.whole(firsts), ends, ends[1:]))
        return [self.end if k is None else next(units) if k else next(whole) + self.end for k in kinds]


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int | None) -> UnitEncoder:
    """A worker's encoder: what it has learnt serves its next task, too. A task has one core, so the library's own threads
    would only wait for work on the cores of others."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return UnitEncoder(path, end_id)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes text_col and writes shard files to folder, in ascending order of id_col over all shards (nulls first;
    rows of one id by a hash of their text). Returns the shards, which are the folder's manifest: (shard long, path, n_docs,
    n_tokens, start, first), start being the number of ids in the shards before, first the first id.

    Null texts are empty ones. A file counts only if its task succeeded and named it, so a lost executor's files are
    left aside. An empty table has no shards.
    """
    spark = docs.sparkSession
    place, name = _place(folder)
    place.create_dir(name, recursive=True)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(path, end_id)
        keys, ids, size = [], [], 0

        def close():
            nonlocal keys, ids, size
            fs, base = _place(folder)
            file = f"{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{base}/{file}") as f:
                f.write(shard_bytes(keys, ids, own.width))
            values = {"first": pa.array([keys[0]], kind), "tie": pa.array([tie], pa.int64()), "path": pa.array([f"{folder}/{file}"])}
            values |= {"n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([size // own.width], pa.int64())}
            row = pa.RecordBatch.from_pydict(values)
            keys, ids, size = [], [], 0
            return row

        tie = kind = None
        with no_cycles():
            for batch in batches:
                kind = batch.column(0).type
                text = batch.column(2)
                sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0)).cumsum()
                a = 0
                while a < batch.num_rows:
                    b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, "right")))
                    names, ties = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                    for k, h, x in zip(names, ties, own.encode_all(text.slice(a, b - a).to_pylist())):
                        if not keys:
                            tie = h
                        keys.append(k)
                        ids.append(x)
                        size += len(x)
                        if size >= SHARD_BYTES:
                            yield close()
                    a = b
            if keys:
                yield close()

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.col(text_col).cast("string").alias("_text"))
    ordered = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie")
    shards = staged(ordered.mapInArrow(run, f"first {id_type}, tie bigint, path string, n_docs bigint, n_tokens bigint"), "shards")
    # One task numbers the files: a row for each SHARD_BYTES of ids.
    order = Window.orderBy(F.col("first").asc_nulls_first(), "tie", "path")
    shards = shards.select((F.row_number().over(order) - 1).cast("long").alias("shard"), "path", "n_docs", "n_tokens", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start"), "first")
    shards.write.parquet(f"{folder}/{MANIFEST}")
    return token_files(spark, folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder, by its manifest: (shard long, path, n_docs, n_tokens, start, first)."""
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def read_token_files(shards: DataFrame, id_type: str = "bigint", ids: bool = False) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long and, if asked for, ids array<int>) of the shards' documents.

    Every document is looked up by its key in its shard's hash. ids_crc32 is over the ids as little-endian uint32.
    """
    schema = StructType.fromDDL(f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = read_shard(path)
                keys, seen, named = shard.keys(), {}, []
                for k in keys:
                    seen[k] = seen.get(k, -1) + 1
                    named.append((k, seen[k]))
                at = shard.find(named)
                if (at < 0).any():
                    raise ValueError(f"{path}: its index doesn't have all of its keys")
                places, payload = shard.whole(shard.begins, "<u8").astype(np.int64), shard.whole(shard.ids, shard.kind)
                begins, ends = places[at], places[at + 1]
                for a in range(0, len(named), 4096):
                    spans = list(zip(begins[a : a + 4096].tolist(), ends[a : a + 4096].tolist()))
                    crc = [zlib.crc32(payload[x:y].astype("<u4").tobytes()) for x, y in spans]
                    cols = [pa.array(keys[a : a + 4096], pa.int64() if id_type == "bigint" else None)]
                    cols += [pa.array([start + x for x, _ in spans], pa.int64()), pa.array([y - x for x, y in spans], pa.int64()), pa.array(crc, pa.int64())]
                    if ids:
                        cols.append(pa.array([payload[x:y].astype(np.int32) for x, y in spans], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    return shards.select("path", "start").repartition("path").mapInArrow(run, schema)


def token_folder(spark) -> str:
    """A fresh folder for shard files in the shared one."""
    return fresh_path(spark, "token-ids")
