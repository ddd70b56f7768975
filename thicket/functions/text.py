"""Text rules of the knowledge graph, as columns (survey ids TXT, EXT-15, EXT-21, EXT-22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of an exceeded context window; model names and their windows, most specific name first.
OVERFLOW_SIGNS = ["context length", "context window", "too long", "token limit", "max tokens", "exceeds", "context size", "input length", "too many tokens", "sequence length"]
CONTEXT_WINDOWS = [
    ("llama3.2", 8192), ("llama-3.2", 8192), ("phi3:mini", 4096), ("phi-3-mini", 4096), ("mistral", 32768), ("qwen2.5:3b", 8192), ("qwen2.5:7b", 32768), ("gemma2:2b", 4096),
    ("gemma2:9b", 8192), ("llama3.3", 128000), ("llama-3.3", 128000), ("qwen2.5:72b", 32768), ("claude-3-opus", 200000), ("claude-3-sonnet", 200000), ("claude-3-haiku", 200000),
    ("gpt-4o", 128000), ("gpt-4", 8192), ("gpt-3.5", 16385), ("gemini", 1048576),
]
DEFAULT_WINDOW, PROMPT_RESERVE = 4096, 700


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space (Unicode's) at either end. Inner runs of it are looked at once, from their start."""
    return F.regexp_replace(_col(c), r"(?U)^\s++|\s(?<!\s\s)\s*+$", "")


def norm_key(c: Column | str) -> Column:
    """TXT-01: what identifies a node: its label in lower case, trimmed."""
    return trimmed(F.lower(_col(c)))


def contains_term(c: Column | str, term: str) -> Column:
    """TXT-15: whether the term occurs, whatever its case; taken literally."""
    return F.contains(F.lower(_col(c)), F.lit(term.lower()))


def same_label(a: Column | str, b: Column | str) -> Column:
    """TXT-16."""
    return F.lower(_col(a)) == F.lower(_col(b))


def content_hash(c: Column | str) -> Column:
    """TXT-17."""
    return F.sha2(_col(c), 256)


def token_estimate(c: Column | str) -> Column:
    """TXT-07: a token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(_col(c)) / 4).cast("int")


def context_window(model: Column | str) -> Column:
    """TXT-11: tokens that a model's context holds; the first name that occurs in the model's decides."""
    name = F.lower(_col(model))
    return reduce(lambda rest, rule: F.when(F.contains(name, F.lit(rule[0])), F.lit(rule[1])).otherwise(rest), reversed(CONTEXT_WINDOWS), F.lit(DEFAULT_WINDOW))


def chunk_target(window: Column | str) -> Column:
    """TXT-10: half of what the prompt leaves of the window."""
    return F.floor(F.greatest(_col(window) - PROMPT_RESERVE, F.lit(0)) / 2).cast("int")


def chunk_overlap(target: Column | str) -> Column:
    """TXT-10: a tenth of the target."""
    return F.floor(_col(target) / 10).cast("int")


def is_overflow(message: Column | str) -> Column:
    """EXT-15: whether an error says that the context window was exceeded."""
    lower = F.lower(_col(message))
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(s)) for s in OVERFLOW_SIGNS])


def _any(path: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(w)) for w in words])


def priority(source: Column | str) -> Column:
    """EXT-21: how much a document is worth reading, by its path."""
    p = F.lower(_col(source))
    points = [(_any(p, ["readme", "skill", "toc"]), 100), (_any(p, ["overview", "getting-started"]), 50), (_any(p, ["example", "guide"]), 30), (_any(p, ["generated", "auto"]), -50), (F.endswith(p, F.lit(".md")), 10)]
    return reduce(lambda a, b: a + b, [F.when(test, F.lit(n)).otherwise(F.lit(0)) for test, n in points])


def skippable(source: Column | str, text: Column | str, least_bytes: int = 100) -> Column:
    """EXT-22: generated and link files, data files and texts of a few bytes."""
    p = F.lower(_col(source))
    return _any(p, ["generated", "broken-links", "source-reference-map"]) | (F.octet_length(_col(text)) < least_bytes) | F.endswith(p, F.lit(".json"))


def escape_csv(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit('"'), F.lit('""'))


def escape_xml(c: Column | str) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], _col(c))


def escape_cypher(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def plain_number(c: Column | str) -> Column:
    """TXT-19: a double as its shortest text: 4 for 4.0."""
    x = _col(c)
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def clean_pdf(c: Column | str) -> Column:
    """TXT-04: trimmed lines that aren't blank; pairs of spaces become one, once; no NUL and byte-order marks."""
    lines = F.filter(F.transform(F.split(_col(c), "\n"), trimmed), lambda x: x != "")
    text = F.replace(F.array_join(lines, "\n"), F.lit("  "), F.lit(" "))
    return F.translate(text, "\u0000﻿", "")
