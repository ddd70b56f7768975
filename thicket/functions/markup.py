"""Markdown and HTML to text (TXT-02, TXT-03), and a minimal reader of PDF text (SRC-07)."""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

#: A run of marks opens emphasis if no space follows it, and closes it if none stands before it.
_INLINE = [
    (re.compile(r"\\([!-/:-@\[-`{-~])|`+([^`]+)`+|\0"), ""), (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\[[^\]]*\]"), r"\1"), (re.compile(r"<(https?://[^>\s]+)>"), r"\1"), (re.compile(r"</?[A-Za-z][^>]*>"), ""),
    (re.compile(r"(?<!\*)\*\*\*(?![\s*])(.+?)(?<![\s*])\*\*\*(?!\*)"), r"\1"), (re.compile(r"(?<!\w)___(?![\s_])(.+?)(?<![\s_])___(?!\w)"), r"\1"),
    (re.compile(r"(?<!\*)\*\*(?![\s*])(.+?)(?<![\s*])\*\*(?!\*)"), r"\1"), (re.compile(r"(?<!\w)__(?![\s_])(.+?)(?<![\s_])__(?!\w)"), r"\1"),
    (re.compile(r"(?<![\w*])\*(?![\s*])([^*]+?)(?<!\s)\*(?!\*)"), r"\1"), (re.compile(r"(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)"), r"\1"),
]
_HEAD = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(.*)$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_UNDER = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")


def _inline(text: str) -> str:
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[1] or m[2] or "\0")
        return f"\0{len(held) - 1}\0"

    text = _INLINE[0][0].sub(keep, text)  # escaped marks and code are taken as they are
    for pattern, to in _INLINE[1:]:
        text = pattern.sub(to, text)
    return re.sub("\0([0-9]+)\0", lambda m: held[int(m[1])], text)


def markdown_to_text(source: str | None) -> str:
    """Paragraphs and headings end with a blank line; list items begin with '- '; fenced code stands between [code] and
    [/code]; quotes begin with '> '; emphasis, links and HTML lose their marks; rules are left out."""
    out: list[str] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            out.append(_inline("\n".join(para)) + "\n")
            para.clear()

    lines, i = (source or "").replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if fence := _FENCE.match(line):
            flush()
            code = []
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            out.append("[code]\n" + "\n".join(code) + "\n[/code]\n")
        elif not line.strip():
            flush()
        elif para and _UNDER.match(line):
            flush()
        elif _RULE.match(line):
            flush()
        elif head := _HEAD.match(line):
            flush()
            out.append(_inline(head[1] or "") + "\n")
        elif item := _ITEM.match(line):
            flush()
            out.append("- " + _inline(item[1]))
        elif line.lstrip().startswith(">"):
            flush()
            out.append("> " + _inline(line.lstrip()[1:].strip()) + "\n")
        elif line.startswith("    ") and not para:
            out.append("[code]\n" + line[4:] + "\n[/code]\n")
        else:
            para.append(line.strip())
    flush()
    return "\n".join(x.rstrip() for x in "\n".join(out).split("\n")).strip()


class _Text(HTMLParser):
    """Texts of the whole page and inside its first main, article and body."""

    skipped = frozenset({"script", "style", "noscript"})
    inside = ("main", "article", "body")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.open: dict[str, int] = {}
        self.done: set[str] = set()
        self.parts: dict[str, list[str]] = {"": []}

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skipped
        if tag in self.inside and tag not in self.done:
            self.open[tag] = self.open.get(tag, 0) + 1
            self.parts.setdefault(tag, [])

    def handle_endtag(self, tag):
        self.depth -= tag in self.skipped and self.depth > 0
        if self.open.get(tag):
            self.open[tag] -= 1
            if not self.open[tag]:
                self.done.add(tag)

    def handle_data(self, data):
        if not self.depth and (piece := data.strip()):
            for where, texts in self.parts.items():
                if not where or self.open.get(where):
                    texts.append(piece)


def html_to_text(source: str | None) -> str:
    """The text of the first main, else article, else body, else of all: one line. Entities that are left after parsing
    (of double escapes) are decoded once more."""
    page = _Text()
    page.feed(source or "")
    page.close()
    text = " ".join(next((page.parts[t] for t in _Text.inside if t in page.parts), page.parts[""]))
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = text.replace(entity, char)
    return " ".join(text.split())


_STREAM, _SHOWN = re.compile(rb"stream\r?\n(.*?)endstream", re.S), re.compile(rb"\((?:\\.|[^\\()])*\)|\bT\*|\bT[dD]\b|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}


def pdf_to_text(content: bytes) -> str:
    """The strings that a PDF's streams show (plain or deflated), a line for each move. Fonts with encodings of their
    own are beyond it. Raises ValueError for what isn't a PDF."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    out = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for shown in _SHOWN.findall(data) if b"BT" in data else []:
            if shown[:1] != b"(":
                out.append("\n")
            else:
                out.append(re.sub(rb"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), shown[1:-1], flags=re.S).decode("latin-1"))
    lines = [x.strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x).replace("  ", " ").replace("\0", "").replace("﻿", "")
