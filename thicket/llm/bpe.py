"""BPE encoding and decoding with content-defined chunks that are encoded once.

Texts are cut where a rolling hash of the last bytes has a fixed pattern, so a passage that many documents share is cut
alike in all of them. A worker keeps the ids of the chunks that it has met, by a 128-bit digest, and encodes a chunk only
when it is new to it; what it has learnt serves its next task, too. Memory is bounded: when MEMO_BYTES of ids are held,
chunks that were not met since the last such time are forgotten. (Texts stay where they are read: dealing them to workers
by their chunks would write the corpus to disk once more.)

At a joint of two chunks the words on either side are encoded again as one piece and compared with what the chunks gave;
on disagreement more words are taken in, twice as many each time, and a text of which a joint agrees nowhere is encoded
whole. Cuts are made only before a space between ASCII characters, of which a word or number follows it: there the
pre-tokenizers of CHUNKED kinds begin a new piece whatever is before. Texts of other tokenizers are one chunk each.

The words of a new chunk are looked up in turn, where the tokenizer drops white space: a smaller unit of the same reuse.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import for_python, no_cycles, with_fields

WINDOW, MASK_BITS, LEAST, REACH = 32, 11, 256, 64
#: Bytes of ids that a worker remembers (twice as many, just before it forgets), and of text that it works on at a time.
MEMO_BYTES, SLICE_BYTES = 12_000_000, 2_000_000
#: Words and joints that a worker remembers.
MEMO_WORDS, MEMO_JOINTS = 150_000, 20_000

#: A 32-bit number for each byte, from a multiplicative rule.
_BYTE = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Before and after a space at which a text may be cut.
_SOLID = np.array([33 <= b < 127 for b in range(256)])
_WORDS = np.array([bytes([b]).isalnum() for b in range(256)])
_CLEAN = re.compile(rb"(?<=[!-~]) (?=[0-9A-Za-z])")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the WINDOW bytes up to it (of fewer at the start), by doubling windows."""
    h, power, width = _BYTE[data], np.uint32(0x01000193), 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            longer = h.copy()
            longer[width:] += h[:-width] * power
            h, power, width = longer, power * power, 2 * width
    return h


def cuts(data: bytes) -> list[int]:
    """Where data (UTF-8) is cut, its end included: at the first clean space after a hit of the hash, if it is near."""
    n = len(data)
    if n <= 2 * LEAST:
        return [n]
    b = np.frombuffer(data, np.uint8)
    hits = np.flatnonzero((rolling_hash(b) >> np.uint32(32 - MASK_BITS)) == 0) + 1
    clean = np.flatnonzero((b[1:-1] == 32) & _SOLID[b[:-2]] & _WORDS[b[2:]]) + 1
    if not len(clean) or not len(hits):
        return [n]
    at = np.searchsorted(clean, hits)
    hits, at = hits[at < len(clean)], at[at < len(clean)]
    out, last = [], 0
    for i in np.unique(clean[at][clean[at] - hits < REACH]).tolist():
        if i - last >= LEAST and n - i >= LEAST:
            out.append(i)
            last = i
    return [*out, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)] if data else []


def _steps(part: dict | None, inner: str) -> list[dict]:
    """A normalizer or pre-tokenizer of a tokenizer's file, as a list of steps."""
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


def chunked_kind(spec: dict) -> str | None:
    """How a tokenizer, by its file, treats spaces: 'words' (it drops white space, and no piece crosses it), 'bytes' (a
    piece begins at a space before a word); None if neither is sure."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].strip() or " " in t["content"] for t in spec["added_tokens"]):
        return None
    before = _steps(spec["pre_tokenizer"], "pretokenizers")
    spaces = {"NFC", "NFKC", "NFD", "NFKD", "Lowercase", "Replace", "StripAccents"}
    steps = _steps(spec["normalizer"], "normalizers")
    if not before or spec["model"].get("type") != "BPE" or not {x["type"] for x in steps} <= spaces:
        return None
    if any(x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": r"\s+"}, " ") for x in steps):
        return None
    first = before[0]
    if first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return "words"
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]:
        return None if regex.search(first["pattern"]["Regex"], " \t\r\n\x0b\x0c") else "words"
    if first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not steps and len(before) == 1:
        return "bytes"
    return None


def spaces(left: bytes, right: bytes) -> tuple[list[int], list[int]]:
    """The clean spaces near the joint of two chunks, on each side."""
    base = max(0, len(left) - 8 * REACH)
    return [base + m.start() for m in _CLEAN.finditer(left[base:])], [m.start() for m in _CLEAN.finditer(right[: 8 * REACH])]


def around(left: bytes, right: bytes, k: int = 1, places: tuple[list[int], list[int]] | None = None) -> tuple[bytes, bytes]:
    """The last k words of left and the first k of right, by clean spaces; all, where there are fewer."""
    if places is None and k == 1:  # as most often: only the last clean space of left and the first of right
        near = [m.start() for m in _CLEAN.finditer(left[-REACH:])]
        first = _CLEAN.search(right, 0, 8 * REACH)
        if near and first:
            return left[near[-1] - min(len(left), REACH) :], right[: first.start()]
    ends, starts = places or spaces(left, right)
    return left[ends[-k] :] if k <= len(ends) else left, right[: starts[k - 1]] if k <= len(starts) else right


class ChunkEncoder:
    """Encodes texts as a tokenizer of the tokenizers library does, a distinct chunk once. Ids are raw bytes, of two or
    four bytes each (kind). encoded counts the chunks that were encoded, met all chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.old_memo: dict[bytes, bytes] = {}
        self.held = self.encoded = self.met = 0
        self.joints: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.spaces = chunked_kind(spec)
        self.folds = any(x["type"] == "Lowercase" for x in _steps(spec["normalizer"], "normalizers"))
        self.marks = frozenset(m for m in b".,;:!?" if self.spaces == "words" and self._stands_alone(chr(m)))
        # Which tokens end a piece, where a suffix tells.
        suffix = spec["model"].get("end_of_word_suffix") if self.spaces == "words" else None
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        # Without a decoder the library puts a space between tokens.
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)] if spec["decoder"] is None else None

    def _stands_alone(self, mark: str) -> bool:
        """Whether mark after a letter or digit is a piece of its own."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return all(cut(f"{x}{mark}")[-1][1] == (2, 3) for x in ("ab", "a1", "11"))

    def raw(self, data: bytes) -> bytes:
        return np.array(self.tokenizer.encode(data.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, parts: dict[bytes, bytes]) -> None:
        """Remembers the ids of chunks (digest to bytes)."""
        self.met += len(parts)
        if self.held > MEMO_BYTES:
            self.old_memo, self.memo, self.held = self.memo, {}, 0
        new = {}
        for d, p in parts.items():
            if d not in self.memo:
                if (ids := self.old_memo.get(d)) is None:
                    new[d] = p
                else:
                    self.memo[d] = ids
                    self.held += len(ids)
        self.encoded += len(new)
        for d, ids in zip(new, self._encode(list(new.values()))):
            self.memo[d] = ids
            self.held += len(ids)

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        if self.spaces != "words":
            return self._batch(parts)
        split = [(p.lower() if self.folds and b"<|" not in p else p).split() for p in parts]
        if len(self.words) > MEMO_WORDS:  # words that were met lately stay
            self.older, self.words = self.words, {}
        self._learn_words(set().union(*split).difference(self.words))
        ids = self.words.__getitem__
        return [b"".join(map(ids, x)) for x in split]

    def _learn_words(self, unseen: set[bytes]) -> None:
        """A word with a mark at its end has the ids of the word and those of the mark."""
        known, marks = self.words, self.marks
        if self.older:
            again = unseen.intersection(self.older)
            known.update((w, self.older[w]) for w in again)
            unseen = unseen - again
        marked = [w for w in unseen if w[-1] in marks and w[-2:-1].isalnum()]
        plain = unseen.difference(marked)
        plain.update(w[:-1] for w in marked)
        plain.update(bytes([m]) for m in marks)
        plain.difference_update(known)
        letters = [w for w in plain if w.isalpha() or not w.isascii() and w.decode("utf-8", "surrogatepass").isalpha()] if self.last is not None else []
        known.update(zip(letters, self._apart(letters)))
        fresh = list(plain.difference(letters))
        known.update(zip(fresh, self._batch(fresh)))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)

    def _apart(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters. Such a word is one piece, as a rule, and a token with the suffix ends it, so that
        many can be encoded as one text; where not all of them are one piece, each is encoded alone."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, cut = ids.astype(self.kind).tobytes(), (stops * self.kind.itemsize).tolist()
                out += [raw[x:y] for x, y in zip([0, *cut], cut)]
            else:
                out += self._batch(some)
        return out

    def _batch(self, parts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(parts), 4096):  # encodings are large while they last
            some = [p.decode("utf-8", "surrogatepass") for p in parts[at : at + 4096]]
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def joint(self, left: bytes, right: bytes, known: bool | None = None) -> int | None:
        """How many words a side, around the joint of two chunks, have as one piece the ids that both sides have apart;
        None if no number has. known: whether one word a side has."""
        k, places = 1, None
        while True:
            tail, head = around(left, right, k, places)
            if self._agree(tail, head) if known is None else known:
                return k
            if len(tail) == len(left) and len(head) == len(right):
                return None
            k, known = 2 * k, None
            places = places or spaces(left, right)

    def _agree(self, tail: bytes, head: bytes) -> bool:
        self._compare([(tail, head)])
        return self.joints[tail, head]

    def _compare(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """Remembers for pairs of pieces whether their ids apart are those that they have as one."""
        if len(self.joints) > MEMO_JOINTS:
            self.joints.clear()
        new = [x for x in dict.fromkeys(pairs) if x not in self.joints]
        apart = list(dict.fromkeys(p for x in new for p in x))
        ids = dict(zip(apart, self._encode(apart)))
        self.joints.update((x, one == ids[x[0]] + ids[x[1]]) for x, one in zip(new, self._batch([a + b for a, b in new])))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        datas = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        cut = [chunks(d) if self.spaces else [d] if d else [] for d in datas]
        ends = [[around(a, b) for a, b in zip(own, own[1:])] for own in cut]
        self._compare([x for e in ends for x in e])
        plan, parts = [], {}
        for data, own, joints in zip(datas, cut, ends):
            good = (self.joint(a, b, self.joints[x]) for a, b, x in zip(own, own[1:], joints))
            own = [data] if any(k is None for k in good) else own
            keys = [xxhash.xxh3_128_digest(p) for p in own]
            parts.update(zip(keys, own))
            plan.append(keys)
        self._learn(parts)
        ids = self.memo.__getitem__
        return [b"".join(map(ids, keys)) for keys in plan]

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer does; one that has no decoder puts a space between tokens."""
        if self.tokens is not None:
            return " ".join([self.tokens[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder: what it has learnt serves its next task, too."""
    return ChunkEncoder(path)


def _slices(column: pa.Array, most: int):
    """(start, stop) of runs of rows with about so many bytes of text."""
    ends = np.asarray(pc.fill_null(pc.binary_length(column), 0)).cumsum()
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def encode(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True, digests: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens (long) and, if asked for, token_ids (array<int>), and digests: ids_sha256 (of the decimal ids,
    joined by a space) and decoded_sha256 (of the text that decoding gives).

    Ids are those of Tokenizer.encode(text, add_special_tokens=False) without truncation or padding; null and empty
    texts have none. Columns of docs with those names are replaced; rows are neither added nor dropped. Without keep_text
    the text isn't sent back from Python.
    """
    added = ["n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    given, at, back = for_python(docs, text_col, added, keep_text)
    schema = with_fields(given.select(*back), "n_tokens bigint" + ", token_ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests)

    def run(batches):
        own = encoder(path)
        names = [str(i) for i in range(own.tokenizer.get_vocab_size())]
        with no_cycles():
            for batch in batches:
                text = batch.column(at)
                for a, b in _slices(text, SLICE_BYTES):
                    got = [np.frombuffer(g, own.kind) for g in own.encode_all(text.slice(a, b - a).to_pylist())]
                    sizes = np.array([len(g) for g in got], np.int64)
                    cols = [batch.column(c).slice(a, b - a) for c in back] + [pa.array(sizes)]
                    if ids:
                        flat = np.concatenate([*got, np.zeros(0, own.kind)]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat)))
                    if digests:
                        sums = [[], []]
                        for g in map(np.ndarray.tolist, got):
                            sums[0].append(hashlib.sha256(" ".join([names[i] for i in g]).encode()).hexdigest())
                            sums[1].append(hashlib.sha256(own.decode(g).encode("utf-8", "surrogatepass")).hexdigest())
                        cols += [pa.array(x, pa.string()) for x in sums]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with text_col, the text of ids_col (null for null)."""
    @F.pandas_udf("string")
    def text(column):
        own = encoder(path)
        return column.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return encoded.withColumn(text_col, text(F.col(ids_col)))
