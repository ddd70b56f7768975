import json

import pytest
from pyspark.sql import functions as F

from thicket.operators.answers import first_array, parse_answers, without_fence
from thicket.operators.extract import Domain, HttpExtractor, RuleExtractor, build_prompt, concepts, extract, extractor, is_overflow
from thicket.operators.selection import batch_payload, batches
from thicket.plans.ingest import triples_of


def item(a="rust", b="tokio", edge="uses", **more):
    return {"node_1": a, "node_2": b, "edge": edge, **more}


GOOD = json.dumps([item(), item("x", "y")])
CASES = {
    GOOD: 2, f"Sure! {GOOD}": 2, f"{GOOD} That is all [really].": 2, f"```json\n{GOOD}\n```": 2, f"```\n{GOOD}\n```\n": 2, "[]": 0, "no json here": 0, "": 0, "[1, 2": 0,
    json.dumps([item(edge="has [brackets] ] in it")]): 1, json.dumps([item(edge='says \\"hi\\" [')]): 1, json.dumps([item("", "y"), item("a", "A "), item("p", "q")]): 1, json.dumps([item("  RUST  ", "Tokio")]): 1,
    json.dumps([item(extra=[1, [2]])]): 1, json.dumps([item(node_1_type="lang", node_2_type=None)]): 1, f"é ü 漢 {GOOD}": 2, f"Prose\n```json\n{GOOD}\n```": 2, json.dumps([item("caf\\u00e9", "b")]): 1, json.dumps(item()): 0, "[not json]": 0,
}


@pytest.mark.parametrize("answer", CASES)
def test_answers(spark, answer):
    assert parse_answers(spark.createDataFrame([(1, answer)], "id int, answer string")).count() == CASES[answer]


def test_values(spark):
    row = parse_answers(spark.createDataFrame([(7, json.dumps([item(" Café ", "B", " is near ", node_1_type="Place")]))], "id int, answer string")).first()
    assert (row.id, row.pos, row.node_1, row.node_1_type, row.node_2, row.node_2_type, row.edge) == (7, 0, "café", "Place", "b", None, "is near")


@pytest.mark.parametrize("bad", [{"node_1": "q"}, {"node_1": 5, "node_2": "b", "edge": "c"}, "text", 3, None, {"node_1": "a", "node_2": "b", "edge": None}, item(node_1_type=4)])
def test_one_bad_element(spark, bad):
    df = spark.createDataFrame([(json.dumps([item(), bad, item("x", "y")]),), (None,)], "answer string")
    assert parse_answers(df).count() == 0 and parse_answers(df, strict=False).count() == 2


def test_parts(spark):
    get = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert get(without_fence, " ```json\n[1]\n```\nmore") == "[1]" and get(without_fence, " a ") == "a"
    assert get(first_array, 'x [1, "]", [2]] y]') == '[1, "]", [2]]' and get(first_array, "[1") is None and get(first_array, "none") is None


def plain_array(text):
    """From the first [ to its match, a character at a time."""
    at, depth, inside, escaped = text.find("["), 0, False, False
    for i, c in enumerate(text[at:] if at >= 0 else "", at):
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                return text[at : i + 1]
    return None


def test_arrays_of_drawn_texts(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choices('[]"\\a\n é', [5, 5, 3, 2, 3, 1, 1, 1], k=rng.randrange(40))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", first_array(F.col("t")).alias("a")).collect()
    assert [(r.t, r.a) for r in got] == [(t, plain_array(t)) for t in texts] and sum(r.a is not None for r in got) > 300


MEGA = 1_000_000
LONG = {
    "a long name": (json.dumps([item("n" * MEGA), item("x", "y")]), 2), "a long name amid prose": ("So: " + json.dumps([item("n" * MEGA), item("x", "y")]) + " [end]", 2), "escapes": ("See " + json.dumps([item('"\\' * (MEGA // 4))]) + " there", 1),
    "an open quote": ('[1, "' + "n" * MEGA, 0), "an open quote after brackets": ('[] ["' + "n] " * (MEGA // 4), 0), "brackets": ("[" * 50_000 + "]" * 50_000 + " x", 0), "open brackets": ("[" * 100_000, 0), "pairs": ("[" + "[]," * 100_000 + "1] x", 0),
    "quotes": ('["' + '""' * (MEGA // 2), 0), "backslashes": ('["' + "\\" * MEGA, 0), "blanks": ("[1," + " " * MEGA + "x", 0), "a fence": ("```json\n" + json.dumps([item("n" * MEGA)]) + "\n```", 1), "fences": ("```\n" + "`" * MEGA, 0),
}


@pytest.mark.parametrize("case", LONG)
def test_long_answers_neither_end_the_jvm_nor_take_long(spark, case):
    import time

    text, n = LONG[case]
    began = time.time()
    assert parse_answers(spark.createDataFrame([(text,)], "answer string"), strict=False).count() == n
    assert spark.createDataFrame([(text,)], "answer string").select(first_array(F.col("answer")).alias("a")).first().a == plain_array(text)
    assert time.time() - began < 60


# --- extractors


def test_prompts():
    text = build_prompt(Domain("physics", "lab notes", ["particle", "law"], "decay"))
    assert all(x in text for x in ("physics", "lab notes", "particle, law", "decay")) and "physics" not in build_prompt()


def test_requests(monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    for kind in HttpExtractor.KINDS:
        e = HttpExtractor(kind, "m")
        headers, body = e.request("hello")
        assert "hello" in json.dumps(body)
    assert HttpExtractor("openai").request("x")[0]["Authorization"] == "Bearer k"
    assert HttpExtractor("google", "m1").url.endswith("/m1:generateContent")
    assert HttpExtractor("anthropic").answer({"content": [{"text": "a"}]}) == "a" == HttpExtractor("ollama").answer({"message": {"content": "a"}}) == HttpExtractor("openai").answer({"choices": [{"message": {"content": "a"}}]}) == HttpExtractor("google").answer({"candidates": [{"content": {"parts": [{"text": "a"}]}}]})
    with pytest.raises(ValueError):
        extractor("nobody")
    assert extractor("rules") is RuleExtractor and extractor("openai", None, "conf")().model == "conf" and extractor("openai", "cli", "conf")().model == "cli"


def test_fallback_and_overflow(spark):
    def make():
        def call(text):
            if text.startswith("Document:"):
                raise RuntimeError("bad batch")
            if len(text) > 300:
                raise RuntimeError("prompt is too long")
            if "boom" in text:
                raise RuntimeError("network error")
            return "[]"

        return call

    rows = [("s", 0, "fine text"), ("s", 1, "boom"), ("s", 2, "a sentence of words. " * 40)]
    b = batches(spark.createDataFrame(rows, "source string, chunk_index int, text string"))
    out = extract(batch_payload(b).join(b, ["source", "batch"]), make, target=200).collect()
    assert [r.error for r in out if r.status == "error"] == ["network error"] and sum(r.status == "ok" for r in out) > 3
    assert is_overflow("Context Window exceeded") and not is_overflow("no")


def test_rules_make_triples(spark):
    docs = spark.createDataFrame([("a.txt", "Ownership prevents mistakes. Compilers enforce ownership everywhere."), ("b.txt", "nothing")], "source string, text string")
    got = {(r.node_1, r.node_2) for r in triples_of(docs, RuleExtractor).collect()}
    assert {("ownership", "prevents"), ("prevents", "mistakes"), ("compilers", "enforce")} <= got
    again = spark.createDataFrame([('Here: [{"entity": "x", "importance": 3, "category": "c"}, {"entity": " "}]',)], "answer string")
    assert [tuple(r) for r in concepts(again).collect()] == [("x", 3, "c")]
