"""Running relation extractors over chunks (survey ids EXT-01 to EXT-08, EXT-14, EXT-16)."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.chunking import chunk_tokens
from thicket.functions.text import OVERFLOW_SIGNS


@dataclass
class Domain:
    """What an extractor is told about the texts' field."""

    name: str | None = None
    context: str | None = None
    entity_types: list[str] = field(default_factory=list)
    focus: str | None = None


class Extractor(Protocol):
    """EXT-01: one text to an answer, as the answer parser takes it (a JSON array of triples)."""

    def __call__(self, text: str) -> str: ...


def build_prompt(domain: Domain | None = None) -> str:
    """EXT-07: instructions for a model; a domain adds its context, name, types and focus."""
    d = domain or Domain()
    kinds = f"Give each concept a short lower-case type, for instance: {', '.join(d.entity_types)}." if d.entity_types else "Give each concept a short lower-case type that fits it."
    parts = [
        "Read the text and list how its concepts are related.",
        d.context and f"Background: {d.context}",
        d.name and f"The text is about {d.name}.",
        kinds,
        d.focus and f"Look above all for {d.focus}.",
        'Answer with a JSON array only, of objects {"node_1", "node_1_type", "node_2", "node_2_type", "edge"}; all values are strings, nodes have one to four words. Answer [] if there is nothing.',
    ]
    return "\n".join(p for p in parts if p)


CONCEPT_PROMPT = 'List the text\'s key concepts as a JSON array of objects {"entity", "importance" (1 to 5), "category"}. Answer with the array only.'


def concepts(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """EXT-08: (entity, importance, category) rows of answers to CONCEPT_PROMPT, in place of the answer."""
    from thicket.operators.answers import first_array, without_fence

    rows = F.from_json(first_array(without_fence(F.col(answer_col))), "array<struct<entity:string,importance:int,category:string>>")
    return answers.select(*[c for c in answers.columns if c != answer_col], F.inline(rows)).where("entity is not null and trim(entity) <> ''")


def is_overflow(message: str) -> bool:
    return any(s in message.lower() for s in OVERFLOW_SIGNS)


def extract(batches: DataFrame, make: Callable[[], Extractor], retries: int = 3, target: int = 1000) -> DataFrame:
    """(source, batch, part, answer, status, error) for (source, batch, payload, chunks): EXT-14 and EXT-16.

    make() gives a task its extractor. If a batch fails, its chunks are tried one by one; a text that is too long is cut
    at half the target, up to retries times, and all of its pieces are tried. What still fails is a row with its error.
    """

    def attempt(call: Extractor, text: str, tokens: int, left: int) -> Iterator[tuple[str | None, str | None]]:
        try:
            yield call(text), None
        except Exception as e:  # whatever a model's client raises is a row, not the end of the job
            pieces = [c for _, c, _, _ in chunk_tokens(text, tokens // 2, tokens // 20)] if left and is_overflow(str(e)) else []
            if len(pieces) > 1:
                for p in pieces:
                    yield from attempt(call, p, tokens // 2, left - 1)
            else:
                yield None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for pdf in frames:
            rows = []
            for source, batch, payload, chunks in zip(pdf["source"], pdf["batch"], pdf["payload"], pdf["chunks"]):
                found = list(attempt(call, payload, target, 0))
                if found[0][1] is not None:
                    found = [x for c in chunks for x in attempt(call, c["text"], target, retries)]
                rows += [(source, batch, i, a, "ok" if e is None else "error", e) for i, (a, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source", "batch", "part", "answer", "status", "error"])

    return batches.select("source", "batch", "payload", "chunks").mapInPandas(run, "source string, batch bigint, part int, answer string, status string, error string")


# --- extractors -----------------------------------------------------------------------------------------------------


class RuleExtractor:
    """Relations by rule: a long word precedes the next one in its sentence. For tests and for corpora without a model."""

    def __init__(self, least: int = 6):
        self.least = least

    def __call__(self, text: str) -> str:
        out = []
        for sentence in re.split(r"[.!?\n]+", text):
            words = [w for w in re.findall(r"[^\W\d_]+", sentence) if len(w) >= self.least]
            out += [{"node_1": a, "node_1_type": "word", "node_2": b, "node_2_type": "word", "edge": "precedes"} for a, b in zip(words, words[1:])]
        return json.dumps(out)


class HttpExtractor:
    """EXT-03 to EXT-06: a model behind HTTP. The key is read from the environment where the task runs."""

    # Where each kind of service answers, and the model it has by default.
    KINDS = {
        "anthropic": ("https://api.anthropic.com/v1/messages", "claude-sonnet-4-20250514", "ANTHROPIC_API_KEY"),
        "openai": ("https://api.openai.com/v1/chat/completions", "gpt-4o", "OPENAI_API_KEY"),
        "ollama": ("http://localhost:11434/api/chat", "mistral", None),
        "google": ("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "gemini-2.0-flash", "GOOGLE_API_KEY"),
    }

    def __init__(self, kind: str, model: str | None = None, url: str | None = None, domain: Domain | None = None, timeout: int = 300):
        if kind not in self.KINDS:
            raise ValueError(f"provider must be one of {sorted(self.KINDS)}")
        place, default, self.key_name = self.KINDS[kind]
        self.kind, self.model, self.prompt, self.timeout = kind, model or default, build_prompt(domain), timeout
        self.url = (url or place).format(model=self.model)

    def request(self, text: str) -> tuple[dict, dict]:
        """(headers, body) of a call."""
        key = os.environ.get(self.key_name, "") if self.key_name else ""
        say = [{"role": "user", "content": text}]
        if self.kind == "anthropic":
            return {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": 4096, "system": self.prompt, "messages": say}
        if self.kind == "google":
            return {"x-goog-api-key": key}, {"systemInstruction": {"parts": [{"text": self.prompt}]}, "contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": {"temperature": 0, "maxOutputTokens": 4096}}
        body = {"model": self.model, "messages": [{"role": "system", "content": self.prompt}, *say]}
        if self.kind == "ollama":
            return {}, body | {"stream": False, "options": {"temperature": 0.1, "top_p": 0.9, "top_k": 40}}
        return {"Authorization": f"Bearer {key}"}, body | {"temperature": 0, "max_tokens": 4096}

    def answer(self, reply: dict) -> str:
        if self.kind == "anthropic":
            return "".join(p.get("text", "") for p in reply["content"])
        if self.kind == "google":
            return "".join(p.get("text", "") for p in reply["candidates"][0]["content"]["parts"])
        return reply["message"]["content"] if self.kind == "ollama" else reply["choices"][0]["message"]["content"]

    def __call__(self, text: str) -> str:
        headers, body = self.request(text)
        call = urllib.request.Request(self.url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=self.timeout) as reply:
            return self.answer(json.load(reply))


def extractor(provider: str, model: str | None = None, configured: str | None = None, domain: Domain | None = None) -> Callable[[], Extractor]:
    """EXT-02: what makes a provider's extractor; the model is the one given, else the configured one, else the default."""
    if provider == "rules":
        return RuleExtractor
    HttpExtractor(provider)  # an unknown name is told here, not in a task
    return lambda: HttpExtractor(provider, model or configured, domain=domain)
