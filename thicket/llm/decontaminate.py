"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

A text's fingerprints: of each window of WINDOW words, the smallest hash among its k-grams, k = (WINDOW + 1) // 2. Two
texts that share a window of that many words share its fingerprint, so joining the fingerprints finds every document
that may hold a window of an item. In those documents the windows that gave a hit are then compared word by word, which
extends a hit to every word of the shared span.
Items shorter than WINDOW words are one window each, and are winnowed by their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import ascii_lower, broadcast_if, staged, unused

WINDOW = 10
#: Fixed by the contract: what a word is, after A-Z have been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of fingerprints, windows or document keys that are broadcast at most, measured; beyond, Spark shuffles.
BROADCAST_BYTES = 16_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name is value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _winnowed(window: int) -> str:
    """SQL: of each window of the word hashes h, in order, the fingerprint."""
    k = (window + 1) // 2
    least = ", ".join(f"g[i + {j}]" for j in range(window - k + 1))
    least = f"least({least})" if window > k else least
    grams = f"transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(k))}))"
    marks = _let(grams, "g", f"transform(sequence(0, size(h) - {window}), i -> {least})")
    return f"if(size(h) >= {window}, {marks}, array())"


def _fingerprints(lengths: list[int]) -> str:
    """SQL: the distinct fingerprints of the words w, those of each window length apart from the others'."""
    each = [f"transform(array_distinct({_winnowed(n)}), x -> xxhash64(x, {n}))" for n in lengths]
    return _let("transform(w, x -> xxhash64(x))", "h", f"concat({', '.join(each)})")


def _windows(lengths: list[int]) -> str:
    """SQL: start, length and fingerprint of every window of the words w."""
    each = [f"transform({_winnowed(n)}, (x, i) -> named_struct('at', i, 'n', {n}, 'mark', xxhash64(x, {n})))" for n in lengths]
    return _let("transform(w, x -> xxhash64(x))", "h", f"concat({', '.join(each)})")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(n, gram, item): the distinct windows of each item, as text of n words."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = f"least(size(w), {window})"
    grams = f"explode(transform(sequence(1, size(w) - {n} + 1), i -> array_join(slice(w, i, {n}), ' ')))"
    return w.select("item", F.expr(n).alias("n"), F.expr(grams).alias("gram")).distinct()


def _bytes(df: DataFrame, *texts: str) -> int:
    """About how much memory df takes: its texts and 32 bytes a row."""
    each = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(32).cast("long"))
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated): a row for each row of docs, repeated rows included.

    Null and wordless texts have no words and no hits. Items that are null or wordless have no windows; a null item id
    hits words but isn't counted. Without items nothing is hit. Other columns are ignored, whatever their names.
    """
    own = staged(item_windows(items, item_col, item_text_col, window), "windows")
    grams = staged(own.select("n", "gram").distinct(), "grams")
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect()) or [window]  # at most window numbers
    # The fingerprint of an item's window is that of the window alone.
    mark = staged(grams.select(F.split("gram", " ").alias("w")).select(F.explode(F.expr(_fingerprints(lengths))).alias("mark")).distinct(), "marks")
    mark = broadcast_if(mark, _bytes(mark), BROADCAST_BYTES)
    key = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key")]
    seen = docs.select(*key, words(F.col(text_col)).alias("w"))
    seen = staged(seen.select("_id", "_key", F.size("w").cast("long").alias("n_words"), F.expr(_fingerprints(lengths)).alias("marks")), "winnowed")
    hits = staged(seen.select("_id", "_key", F.explode("marks").alias("mark")).join(mark, "mark", "left_semi").select("_id", "_key").distinct(), "hits")
    # The documents with hits: their windows with an item's fingerprint, then those windows' words beside the items'.
    same = lambda a, b: F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._key") == F.col(f"{b}._key"))
    few = broadcast_if(hits, _bytes(hits.select(F.col("_id").cast("string").alias("t")), "t"), BROADCAST_BYTES)
    again = docs.select(*key, F.col(text_col).cast("string").alias("_text")).alias("d").join(few.alias("h"), same("d", "h"), "left_semi")
    again = staged(again.groupBy("_id", "_key").agg(F.first("_text").alias("_text")), "suspects").withColumn("w", words(F.col("_text")))
    spots = again.select("_id", "_key", F.explode(F.expr(_windows(lengths))).alias("p")).select("_id", "_key", "p.*").join(mark, "mark", "left_semi")
    spots = staged(spots.groupBy("_id", "_key").agg(F.collect_list(F.struct("at", "n")).alias("spots")), "spots")
    found = again.alias("d").join(spots.alias("s"), same("d", "s")).select("d._id", "d._key", F.explode(F.expr("transform(spots, p -> named_struct('at', p.at, 'n', p.n, 'gram', array_join(slice(w, p.at + 1, p.n), ' ')))")).alias("p"))
    found = found.select("_id", "_key", "p.*").join(broadcast_if(grams, _bytes(grams, "gram"), BROADCAST_BYTES), ["n", "gram"], "left_semi")
    found = staged(found, "found")
    spans = found.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    # Windows in order of their start: each adds the words beyond the furthest end so far.
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct('n', a.n + greatest(s.end - greatest(s.at, a.end), 0), 'end', greatest(a.end, s.end)), a -> a.n)")
    spans = spans.select("_id", "_key", n_hit.alias("n_hit"))
    ids = found.select("_id", "_key", "n", "gram").distinct().join(own, ["n", "gram"]).where("item is not null").select("_id", "_key", "item").distinct()
    ids = ids.groupBy("_id", "_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    ids = ids.select("_id", "_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = spans.alias("s").join(ids.alias("i"), same("s", "i"), "left").select("s._id", "s._key", "n_hit", "n_items", "items_sha256")
    out = seen.select("_id", "_key", "n_words").alias("d").join(staged(found, "contaminated").alias("f"), same("d", "f"), "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("d._id").alias(id_col), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of an item. Rows are told apart by id and text, so a null id is no obstacle."""
    row = unused("row", docs.columns)
    tagged = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("string"), text_col))
    own = tagged.select(F.col(row).alias("_tag"), F.col(text_col).alias("_body"))
    bad = contamination(own, items, "_tag", "_body", window=window).where("contaminated").select(F.col("_tag").alias(row)).distinct()
    return tagged.join(bad, row, "left_anti").select(*docs.columns)
