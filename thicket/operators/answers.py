"""From a model's answer to triples (survey ids EXT-09 to EXT-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import norm_key, trimmed

_KEYS = ["node_1", "node_2", "edge"]


def without_fence(text: Column) -> Column:
    """EXT-09: what stands between a first line that opens a fence and the last fence; else the text, trimmed."""
    t = trimmed(text)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(F.startswith(t, F.lit("```")) & t.rlike(r"(?s)^```[^\n]*\n.*```"), trimmed(inner)).otherwise(t)


#: Text up to the next bracket that stands outside strings. All repetitions are possessive: the matcher loops over them
#: and keeps no way back, so long strings take no stack, and \G keeps it from starting anew inside a string that no
#: quote ends. (With plain repetitions a string of some thousand characters ends the JVM.)
_TO_BRACKET = r'(?s)\G(?:[^"\[\]]++|"(?:[^"\\]++|\\.)*+(?:"|\z))*+[\[\]]'


def _from_bracket(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A[^\[]*+", "")


def first_array(text: Column) -> Column:
    """EXT-10: from the first [ to its match; null if none closes it. Brackets in strings don't count, and a string that
    no quote ends goes on to the end.

    The text is cut at its brackets; a running count of open ones over the pieces' ends finds the match.
    """
    rest = _from_bracket(text)
    pieces = F.transform(F.regexp_extract_all(rest, F.lit(_TO_BRACKET), F.lit(0)), lambda p: F.struct(F.char_length(p).alias("n"), F.when(F.endswith(p, F.lit("[")), 1).otherwise(-1).alias("step")))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        now = acc["open"] + p["step"]
        return F.when(acc["done"], acc).otherwise(F.struct(now.alias("open"), (acc["length"] + p["n"]).alias("length"), (now == 0).alias("done")))

    length = F.aggregate(pieces, start, step, lambda acc: F.when(acc["done"], acc["length"]))
    return F.when(length.isNotNull(), F.substr(rest, F.lit(1), length))


def answer_items(text: Column) -> Column:
    """The elements of an answer's first array; null if it has none that is JSON. What is JSON from its first bracket to
    its end is that array, and needs no scan."""
    plain = without_fence(text)
    return F.coalesce(F.try_parse_json(_from_bracket(plain)), F.try_parse_json(first_array(plain))).cast("array<variant>")


def _triple():
    """A test of an element: an object whose node_1, node_2 and edge are strings, and its types, if given."""
    kind = lambda x, k: F.schema_of_variant(F.variant_get(x, f"$.{k}", "variant"))

    def good(x: Column) -> Column:
        needed = [F.coalesce(kind(x, k) == "STRING", F.lit(False)) for k in _KEYS]
        optional = [F.coalesce(kind(x, k).isin("STRING", "VOID"), F.lit(True)) for k in ("node_1_type", "node_2_type")]
        out = F.lit(True)
        for test in [*needed, *optional]:
            out = out & test
        return out

    return good


def parse_answers(answers: DataFrame, answer_col: str = "answer", strict: bool = True) -> DataFrame:
    """EXT-11: a row for each triple of an answer: the other columns, pos, and node_1, node_1_type, node_2, node_2_type,
    edge. Nodes are keys, edges trimmed; triples with an empty end or equal ends are left out.

    strict: an answer with an element that isn't a triple of strings gives no rows at all; else only that element is
    left out. Answers without an array give none.
    """
    parsed = answers.withColumn("_items", answer_items(F.col(answer_col)))
    items = F.filter("_items", _triple())
    kept = F.when(F.size(items) == F.size("_items"), items) if strict else items
    rows = parsed.select(*[c for c in answers.columns if c != answer_col], F.posexplode(kept).alias("pos", "_item"))
    get = lambda k: F.try_variant_get("_item", f"$.{k}", "string")
    out = rows.select(
        *[c for c in answers.columns if c != answer_col], "pos",
        norm_key(get("node_1")).alias("node_1"), get("node_1_type").alias("node_1_type"),
        norm_key(get("node_2")).alias("node_2"), get("node_2_type").alias("node_2_type"), trimmed(get("edge")).alias("edge"),
    )
    return out.where("node_1 <> '' and node_2 <> '' and node_1 <> node_2")
