"""Chunkers (TXT-05, 06, 08, 09, 12, 13): texts to overlapping pieces, cut at the coarsest separator that serves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine; beyond the last, a text is cut at characters.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]
LEAST_BYTES = 11


def size_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def estimate(text: str) -> int:
    return math.ceil(size_of(text) / 4)


def windows(text: str, size: int, overlap: int) -> list[str]:
    """TXT-06: windows of size characters; each begins overlap characters before the last one's end."""
    step = max(1, size - max(0, min(overlap, size - 1)))
    out = []
    for at in range(0, len(text), step):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
    return out


def _pieces(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p + separator for p in parts[:-1]] + parts[-1:]


def chunk_text(text: str | None, size: int = 1500, overlap: int = 150, least_bytes: int = LEAST_BYTES) -> list[str]:
    """TXT-05: chunks of at most size bytes, each after the first with the last overlap characters of the one before.

    A text that fits is one chunk. Otherwise chunks under least_bytes are dropped (0 keeps all).
    """
    text = (text or "").strip()
    if not text:
        return []
    return [text] if size_of(text) <= size else _by_bytes(text, size, overlap, 0, least_bytes)


def _by_bytes(text: str, size: int, overlap: int, level: int, least: int) -> list[str]:
    if level >= len(SEPARATORS):
        return [c for c in windows(text, size, overlap) if size_of(c) >= least]
    out: list[str] = []
    held = ""

    def close() -> None:
        if size_of(held) > size:
            out.extend(_by_bytes(held, size, overlap, level + 1, least))
        elif held.strip():
            out.append(held.strip())

    for piece in _pieces(text, SEPARATORS[level]):
        if held and size_of(held) + size_of(piece) > size:
            close()
            held = (out[-1][-overlap:] if out and overlap > 0 else "") + piece
        else:
            held += piece
    close()
    return [c for c in out if size_of(c) >= least]


def chunk_tokens(text: str | None, target: int, overlap: int) -> list[tuple[int, str, int, str | None]]:
    """TXT-08: (index, text, estimated tokens, None) of chunks of about target tokens; each after the first begins with
    the last words of the one before (half of overlap, five at least)."""
    text = (text or "").strip()
    if not text:
        return []
    found = [(text, estimate(text))] if estimate(text) <= target else list(_by_tokens(text, target, overlap, 0))
    return [(i, t, n, None) for i, (t, n) in enumerate(found)]


def _tail(text: str, overlap: int) -> str:
    return " ".join(text.split()[-max(overlap // 2, 5) :]) + " "


def _by_tokens(text: str, target: int, overlap: int, level: int) -> Iterator[tuple[str, int]]:
    if level >= len(SEPARATORS):
        yield from word_windows(text, target, overlap)
        return
    held, total, last = "", 0, ""
    for piece in _pieces(text, SEPARATORS[level]):
        if held and total + estimate(piece) > target:
            if estimate(held) > target:
                for found in _by_tokens(held, target, overlap, level + 1):
                    last = found[0]
                    yield found
            elif held.strip():
                last = held.strip()
                yield last, estimate(held)
            held = (_tail(last, overlap) if last and overlap > 0 else "") + piece
            total = estimate(held)
        else:
            held += piece
            total += estimate(piece)
    rest = held.strip()
    if rest:
        if estimate(rest) > target:
            yield from _by_tokens(rest, target, overlap, level + 1)
        else:
            yield rest, estimate(rest)


def word_windows(text: str, target: int, overlap: int) -> Iterator[tuple[str, int]]:
    """TXT-09: runs of words; a word costs half its bytes and one; the last words of a run begin the next one."""
    held: list[str] = []
    cost = 0
    for word in text.split():
        own = size_of(word) // 2 + 1
        if held and cost + own > target:
            yield " ".join(held), estimate(" ".join(held))
            held = held[-max(overlap // 2, 5) :] if overlap > 0 and len(held) > max(overlap // 2, 5) else []
            cost = sum(size_of(w) // 2 + 1 for w in held)
        held.append(word)
        cost += own
    if held:
        yield " ".join(held), cost


def _exploded(docs: DataFrame, text_col: str, ddl: str, run: Callable) -> DataFrame:
    pieces = F.pandas_udf(lambda s: s.map(run), ddl)
    return docs.withColumn("_piece", F.explode(pieces(F.col(text_col))))


def chunks(docs: DataFrame, size: int = 1500, overlap: int = 150, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(chunk_id, source, chunk_index, text) of documents; the id is a hash of source and index, so runs agree."""
    return _exploded(
        docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("_text")), "_text", "array<struct<chunk_index:int,text:string>>", lambda t: [{"chunk_index": i, "text": c} for i, c in enumerate(chunk_text(t, size, overlap))]
    ).select(chunk_id("source", "_piece.chunk_index").alias("chunk_id"), "source", "_piece.chunk_index", "_piece.text")


def token_chunks(docs: DataFrame, target: int, overlap: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chunk_index, text, estimated_tokens, parent_id) of documents; TXT-12 is the same with a smaller target."""
    over = target // 10 if overlap is None else overlap
    return _exploded(
        docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("_text")),
        "_text",
        "array<struct<chunk_index:int,text:string,estimated_tokens:int,parent_id:string>>",
        lambda t: [{"chunk_index": i, "text": c, "estimated_tokens": n, "parent_id": p} for i, c, n, p in chunk_tokens(t, target, over)],
    ).select("source", "_piece.*")


def char_windows(docs: DataFrame, size: int, overlap: int, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """TXT-06: (source, chunk_index, text): windows() of each document's text, whatever is in it."""
    step = max(1, size - max(0, min(overlap, size - 1)))
    n = F.char_length(text_col)
    rows = docs.where(n > 0).select(F.col(source_col).alias("source"), F.col(text_col).alias("_text"), F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int"))).alias("chunk_index"))
    return rows.select("source", "chunk_index", F.substr("_text", F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))


def chunk_id(source: Column | str, index: Column | str) -> Column:
    return F.sha2(F.concat_ws("#", source, F.col(index).cast("string") if isinstance(index, str) else index.cast("string")), 256)


def rejoined(pieces: DataFrame) -> DataFrame:
    """TXT-13: (source, text): the chunks of each source in order, with blank lines between."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return pieces.groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
