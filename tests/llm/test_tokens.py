"""Token counts, BPE chunks and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thicket.llm.bpe import ChunkEncoder, chunks, cuts, decode, encode
from thicket.llm.token_counts import attribute, section_tokens
from thicket.llm.token_files import TokenFolder, UnitEncoder, build_levels, open_shard, packed, read_shard, read_token_files, shard_bytes, shard_of, slots, token_files, token_folder, write_token_files

WORDS, BYTES, RANKS = path("word_bpe_49k.json"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")
ALPHABET = "abcde fghij   \n\t'sté漢字😀1234!?.,<|endoftext|> ́ 　É\x1c\x85ABC."
ODD = [None, "", " ", "\n\n", "a", "  a  b ", "x" * 5000, "é" * 3000, "a\r\nb\tc", "<|endoftext|>", "A <|endoftext|> b<|startoftext|>c", "<|ENDOFTEXT|> x", "don't, WE'LL. stop!?", "word " * 4000, " x　y", "tail "]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET if i % 3 else "abcé漢'́") for _ in range(rng.choice([3, 60, 700, 3000]))) for i in range(n)]


# --- BPE chunks


def test_chunks_make_the_text_and_follow_its_content():
    body = " ".join(f"word{i * 7919 % 100_003}" for i in range(4000)).encode()
    assert b"".join(chunks(body)) == body and len(chunks(body)) > 5 and cuts(b"") == [0] and chunks(b"") == []
    shared = set(chunks(body)) & set(chunks(b"another beginning of it " + body))
    assert len(shared) > len(chunks(body)) // 2


@pytest.mark.parametrize("file", [WORDS, BYTES])
def test_chunk_encoder_is_exact(file):
    own, t = ChunkEncoder(file), Tokenizer.from_file(file)
    for some in (ODD, texts(120, 1), texts(120, 2)):
        for text, got in zip(some, own.encode_all(some)):
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(got, own.kind).tolist() == ids
            assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("file,kind", [(WORDS, "words"), (BYTES, "bytes")])
def test_each_chunk_is_encoded_once(file, kind, monkeypatch):
    from thicket.llm import bpe

    own, t = ChunkEncoder(file), Tokenizer.from_file(file)
    assert own.spaces == kind
    shared = " ".join(f"word{i * 7919 % 9973}" for i in range(4000))
    some = [f"{'before ' * (i % 5)}{i} {shared} after {i}" for i in range(30)]
    for _ in range(2):
        for text, got in zip(some, own.encode_all(some)):
            assert np.frombuffer(got, own.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    distinct = {c for x in some for c in chunks(x.encode())}
    assert own.encoded == len(distinct) < own.met and len(distinct) < 0.2 * sum(len(chunks(x.encode())) for x in some)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)  # forgets, but stays right
    for text in some[:6] + texts(30, 5):
        assert np.frombuffer(own.encode_all([text])[0], own.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(own.memo) + len(own.old_memo) <= 2 * len(distinct)


def test_joints_that_do_not_agree_make_the_text_whole(monkeypatch):
    own, t = ChunkEncoder(BYTES), Tokenizer.from_file(BYTES)
    text = " ".join(f"word{i * 7919 % 9973}" for i in range(2000))
    monkeypatch.setattr(own, "_compare", lambda pairs: own.joints.update(dict.fromkeys(pairs, False)))
    assert own.joint(b" ab cd", b" ef gh") is None
    own.encode_all([text])
    assert own.encoded == 1
    seen = []
    monkeypatch.setattr(own, "_agree", lambda tail, head: seen.append((tail, head)) or len(seen) > 1)
    assert own.joint(b"xy ab cd", b" ef gh ij") == 2 and seen == [(b" cd", b" ef"), (b" ab cd", b" ef gh")]


def test_other_tokenizers_take_texts_whole(tmp_path):
    from tokenizers import pre_tokenizers

    t = Tokenizer.from_file(BYTES)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "other.json"))
    own = ChunkEncoder(str(tmp_path / "other.json"))
    assert own.spaces is None
    for text, got in zip(ODD + texts(20, 6), own.encode_all(ODD + texts(20, 6))):
        assert np.frombuffer(got, own.kind).tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)] + [(-1, None)], "doc_id long, text string")).withColumn("n_tokens", F.lit("clash"))
    t = Tokenizer.from_file(WORDS)
    out = decode(encode(docs, WORDS, digests=True), WORDS).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = t.decode(ids, skip_special_tokens=False)
        assert r.decoded == back and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert encode(docs.limit(0), WORDS).count() == 0


# --- token counts


def test_attribution_rules():
    ends, at = np.array([2, 7, 9]), np.array([4, 9])
    assert [x.tolist() for x in attribute(ends, at, "start")] == [[2, 1], [1, 0]]
    assert [x.tolist() for x in attribute(ends, at, "majority")] == [[1, 2], [1, 0]]
    assert attribute(np.array([4]), np.array([2, 4]), "majority")[0].tolist() == [1, 0]
    assert attribute(np.array([], int), np.array([0]), "start")[0].tolist() == [0]


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_section_tokens(spark, sf, rule):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")).withColumn("section", F.lit("clash"))
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    got: dict = {}
    for r in section_tokens(docs, RANKS, PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        text, rows = d.text or "", sorted(got[d.doc_id], key=lambda r: r.section)
        e = t.encode(text, add_special_tokens=False)
        assert sum(r.n_tokens for r in rows) == len(e.ids) == rows[0].doc_tokens
        assert [r.start for r in rows] == [0, *(r.stop for r in rows[:-1])] and rows[-1].stop == len(text)
        assert [text[r.start : r.stop] for r in rows] == (text.splitlines(keepends=True) if "\r" not in text and "\n" in text and not set("\x1c\x85 \t") & set(text) else [text[r.start : r.stop] for r in rows])
        if rule == "start" and text.isascii():
            for r in rows:
                assert r.n_tokens == sum(r.start <= a < r.stop for a, _ in e.offsets)
    assert section_tokens(docs.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, RANKS, PATTERN, rule="none")


def test_sections_by_a_longer_separator(spark):
    rows = section_tokens(spark.createDataFrame([(1, "ab##cd##")], "doc_id long, text string"), RANKS, PATTERN, separator="##").collect()
    assert [(r.start, r.stop) for r in sorted(rows, key=lambda r: r.section)] == [(0, 4), (4, 8)]


# --- token files


def test_unit_encoder_is_exact():
    own, t = UnitEncoder(BYTES, 2), Tokenizer.from_file(BYTES)
    for some in (ODD, texts(150, 3), texts(150, 4)):
        for text, got in zip(some, own.encode_all(some)):
            assert np.frombuffer(got, own.kind).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_units_end_at_line_ends(monkeypatch):
    """Known words stay known where they stand at other lines' ends; what is one piece in the text stays one."""
    own, t = UnitEncoder(BYTES, 2), Tokenizer.from_file(BYTES)
    words = "Plain words, of été straße and İstanbul a1. don't ſo x² 中文, end.".split()
    some = [" ".join(words), "\n".join(["", *words]), "\n".join(words[::-1] + [""]), "a " + "\n\n".join(words)]
    tails = ["a b\n\n", "a b\n\n\nc d", "a b\n\n<|endoftext|>\nc", "\n", "\n\n\na b", "a\n\nb c\n"]
    for _ in range(2):
        for text, got in zip(some + tails, own.encode_all(some + tails)):
            assert np.frombuffer(got, own.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    learnt, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda new: learnt.extend(new) or learn(new))
    shuffled = words[3:] + words[:3]
    for text in ("a " + " ".join(shuffled), "a\n" + "\n".join(shuffled), f"a {words[1]}\n{words[4]} {words[0]}\n\n{words[2]}"):
        assert np.frombuffer(own.encode_all([text])[0], own.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    assert learnt == []


def test_forgetting_encoder_stays_exact(monkeypatch):
    from thicket.llm import token_files as module

    monkeypatch.setattr(module, "MEMO_UNITS", 5)
    own, t = UnitEncoder(BYTES, 2), Tokenizer.from_file(BYTES)
    for text in [*texts(30, 6), "a\nb c\n\nd e.\n"] * 2:
        assert np.frombuffer(own.encode_all([text])[0], own.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_minimal_perfect_hash():
    h = np.unique(np.random.default_rng(0).integers(0, 2**64, 20_000, dtype=np.uint64))
    levels = build_levels(h)
    index = [packed(x) for x in levels]
    got = slots(h, [len(x) for x in levels], lambda k, b: (index[k][0][b], index[k][1][b], int(levels[k].sum())))
    assert sorted(got) == list(range(len(h)))
    assert build_levels(np.zeros(0, np.uint64)) == []


def test_shard_finds_its_keys_and_no_others():
    keys = [None, 1, 1, "x", 5]
    shard = shard_of(shard_bytes(keys, [np.array(x, "<u2").tobytes() for x in ([2], [7, 2], [8, 8, 2], [2], [9, 2])], 2))
    assert [shard.ids_of(*k).tolist() for k in ((None,), (1, 0), (1, 1), ("x",), (5,))] == [[2], [7, 2], [8, 8, 2], [2], [9, 2]]
    assert all(shard.ids_of(k) is None for k in range(100, 400)) and shard.ids_of(1, 2) is None
    with pytest.raises(ValueError):
        shard_of(b"nothing of the kind")


@pytest.mark.parametrize("n", [200, 20_000, 200_000])
def test_a_lookup_reads_as_much_whatever_the_size(tmp_path, n):
    ids = np.arange(3, dtype="<u2").tobytes()
    (tmp_path / "a.ids").write_bytes(shard_bytes(list(range(n)), [ids] * n, 2))
    shard, read = open_shard(str(tmp_path / "a.ids")), []
    inner = shard.read
    shard.read = lambda start, length: read.append(length) or inner(start, length)
    for key in range(0, n, n // 50):
        read.clear()
        assert shard.ids_of(key).tolist() == [0, 1, 2]
        assert sum(read) < 1500 and len(read) < 40
    assert shard.ids_of(n + 1) is None


def test_a_later_session_finds_keys(spark, monkeypatch):
    from thicket.llm import token_files as module

    monkeypatch.setattr(module, "SHARD_BYTES", 400)
    rows = [(i, f"text number {i} of many") for i in range(300)] + [(7, "again")] * 40 + [(None, "no id"), (10**12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = token_folder(spark)
    write_token_files(docs, folder, BYTES, 2)
    t, own = Tokenizer.from_file(BYTES), TokenFolder(folder)
    enc = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    for i in (0, 1, 42, 299, 10**12):
        assert own.ids_of(i).tolist() == enc(dict(rows)[i])
    assert own.ids_of(None).tolist() == enc("no id")
    sevens = [own.ids_of(7, k) for k in range(42)]
    assert sevens[41] is None and sorted(x.tolist() for x in sevens[:41]) == sorted([enc("again")] * 40 + [enc("text number 7 of many")])
    assert own.ids_of(-5) is None and own.ids_of(300) is None and token_files(spark, folder).count() == len(own.paths) > 0


def test_files_and_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)] + [(-1, "again"), (-1, "again"), (None, "no id")], "doc_id long, text string")).withColumn("path", F.lit("clash"))
    t = Tokenizer.from_file(BYTES)
    shards = write_token_files(docs, token_folder(spark), BYTES, 2)
    got = sorted(read_token_files(shards, ids=True).collect(), key=lambda r: r.start)
    assert len(got) == docs.count() and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    want = {}
    for d in docs.collect():
        want.setdefault(d.doc_id, []).append([*t.encode(d.text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    first = shards.orderBy("shard").first()
    assert read_shard(first["path"]).ids_of(None).tolist() == want[None][0]
    assert read_token_files(write_token_files(docs.limit(0), token_folder(spark), BYTES, 2)).count() == 0


def test_words_of_letters_are_encoded_together():
    """One text for many words of letters, cut where a suffix ends them; the ids are those of each word alone."""
    import public_tokenizers

    from thicket.llm.bpe import ChunkEncoder

    own = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    alone, batch = [], own._batch
    own._batch = lambda parts: alone.extend(parts) or batch(parts)
    words = "plain Words é naïve don't a1 x. İstanbul Ångström क़a 中文 end".split()
    own._learn_words({w.lower().encode() for w in words[:4]} | {b"none"})
    assert not {b"plain", b"none"} & set(alone)
    own._learn_words({w.encode() for w in words})
    assert all(own.words[w.encode()] == own.raw(w.encode()) for w in words)
