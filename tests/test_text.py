import pytest
from pyspark.sql import functions as F

from thicket.functions import text as T
from thicket.functions.chunking import chunk_text, chunk_tokens, chunks, estimate, size_of, token_chunks, windows
from thicket.functions.markup import html_to_text, markdown_to_text, pdf_to_text

SENTENCES = "The first sentence is here. The second one follows it! Is there a third? There is; and it goes on, a little, to the end. "


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_keys(spark):
    assert one(spark, T.norm_key(F.lit(" \t Ünï Code  \n"))) == "ünï code"


@pytest.mark.parametrize("model,want", [("mistral", 32768), ("Llama3.2:3b", 8192), ("phi3:mini", 4096), ("unknown", 4096), ("gpt-4o-2024", 128000), ("gpt-4", 8192), ("gemini-2", 1048576)])
def test_context_windows(spark, model, want):
    assert one(spark, T.context_window(F.lit(model))) == want


def test_overflow_priority_skip(spark):
    assert [one(spark, T.is_overflow(F.lit(m))) for m in ("Context Length exceeded", "token limit", "input too long", "network error")] == [True, True, True, False]
    score = lambda p: one(spark, T.priority(F.lit(p)))
    assert score("a/README.md") == 110 > score("guide/x") == 30 > score("generated/auto.md") == -40 and score("SKILL") > score("random")
    skip = lambda p, t: one(spark, T.skippable(F.lit(p), F.lit(t)))
    assert skip("x.JSON", "y" * 200) and skip("generated/a.md", "y" * 200) and skip("a.md", "short") and not skip("readme.md", "y" * 200)


def test_numbers_and_escapes(spark):
    assert [one(spark, T.plain_number(F.lit(x))) for x in (4.0, 0.5, 12345678.0, -3.0)] == ["4", "0.5", "12345678", "-3"]
    assert one(spark, T.escape_csv(F.lit('a"b'))) == 'a""b' and one(spark, T.escape_xml(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;" and one(spark, T.escape_cypher(F.lit("a\\'b"))) == "a\\\\\\'b"
    assert one(spark, T.clean_pdf(F.lit("  a  b \n\n \t\n c    d\0﻿"))) == "a b\nc  d"


# --- chunks


def test_chunk_bounds_and_order():
    text = SENTENCES * 30
    for size, overlap in ((50, 10), (200, 20), (1500, 150), (30, 0)):
        found = chunk_text(text, size, overlap)
        assert len(found) > 1 and all(11 <= size_of(c) <= size for c in found)
        if size >= 200:
            assert set(text.split()) <= {w for c in found for w in c.split()}


@pytest.mark.parametrize("text,want", [(None, []), ("", []), (" \n ", []), ("tiny", ["tiny"]), (" fits well ", ["fits well"])])
def test_texts_that_fit(text, want):
    assert chunk_text(text, 1000, 10) == want


def test_overlap_and_separators():
    assert chunk_text("First part here.\n\nSecond part there.", 20, 4) == ["First part here.", "ere.Second part there."[-20:]] or chunk_text("First part here.\n\nSecond part there.", 24, 4)[1] == "ere.Second part there."
    assert chunk_text("a" * 100, 20, 5)[0] == "a" * 20 and "".join(windows("abcdefgh", 3, 0)) == "abcdefgh" and windows("abcdefgh", 4, 2) == ["abcd", "cdef", "efgh"]
    assert windows("abc", 2, 9) == ["ab", "bc"]


def test_wide_characters_and_long_words():
    assert all(chunk_text(t, 50, 5) for t in ("日本語の文章です。" * 20, "x" * 500, "é " * 200))
    assert "".join(chunk_text("漢" * 100, 20, 0)) == "漢" * 100


def test_token_chunks():
    text = SENTENCES * 40
    found = chunk_tokens(text, 100, 20)
    assert [i for i, *_ in found] == list(range(len(found))) and all(n <= 150 for _, _, n, _ in found) and len(found) > 5
    assert set(text.split()) <= {w for _, c, _, _ in found for w in c.split()}
    assert 10 <= estimate("A sentence of about forty-eight bytes is in here") <= 15
    long = "w" * 4000
    assert chunk_tokens(long, 100, 20)[0][1] == long and chunk_tokens(None, 10, 1) == [] and chunk_tokens("a b", 10, 1) == [(0, "a b", 1, None)]


def test_chunk_tables(spark):
    docs = spark.createDataFrame([("a", SENTENCES * 20), ("b", None), ("c", "short")], "source string, text string")
    rows = chunks(docs, 300, 30).collect()
    assert {r.source for r in rows} == {"a", "c"} and len({r.chunk_id for r in rows}) == len(rows) and rows == chunks(docs, 300, 30).collect()
    assert sorted(r.chunk_index for r in token_chunks(docs, 60).where("source = 'a'").collect()) == list(range(token_chunks(docs, 60).where("source = 'a'").count()))


# --- markup


def test_markdown():
    source = "# Title\nA **bold** and `co*de*` [link](http://x) line\nwrapped.\n\n1. one\n- *two*\n\n> said\n\n```py\nx = 1\n```\n---\n<b>raw</b>"
    assert markdown_to_text(source) == "Title\n\nA bold and co*de* link line\nwrapped.\n\n- one\n- two\n> said\n\n[code]\nx = 1\n[/code]\n\nraw"
    assert markdown_to_text(None) == "" and markdown_to_text("snake_case_name 2*3*4") == "snake_case_name 2*3*4"


def test_html():
    assert html_to_text("<html><body><h1>Hi</h1><p>There <b>you</b> are</p><script>no()</script>&amp;amp; &lt;</body></html>") == "Hi There you are & <"
    assert html_to_text("<body>out<main>in<style>x</style></main><article>a</article></body>") == "in" and html_to_text("plain") == "plain" and html_to_text(None) == ""


def test_pdf():
    import zlib

    body = zlib.compress(b"BT (Hello \\(you\\)) Tj T* (Next) Tj ET")
    assert pdf_to_text(b"%PDF-1.4\n1 0 obj<<>>stream\n" + body + b"\nendstream") == "Hello (you)\nNext"
    with pytest.raises(ValueError):
        pdf_to_text(b"no")


def test_windows_of_characters(spark):
    from thicket.functions.chunking import char_windows, windows

    texts = ["", None, "a", "é" * 10, "abcdefghij" * 7, "x" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "source int, text string")
    for size, overlap in ((10, 3), (10, 0), (1, 5), (7, 20), (100, 10)):
        got = sorted((r.source, r.chunk_index, r.text) for r in char_windows(docs, size, overlap).collect())
        assert got == [(s, i, w) for s, t in enumerate(texts) for i, w in enumerate(windows(t or "", size, overlap))]
