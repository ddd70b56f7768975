"""Token counts of a text's sections: the whole text is encoded once and tokens are attributed by their place.

Encoding sections one by one would give other tokens at their edges. Here a document is encoded as a whole; each token
has its span in the text, and the spans are interval-joined to the sections' spans (both are in order, so the join is a
merge by binary search, document by document). A token that crosses a boundary goes where the rule says: 'start' to the
section of its first character, 'majority' to the one with most of its bytes (the earlier, if equal).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RULES = ("majority", "start")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("thicket", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes of the text. A token's bytes are the text's, so lengths add up."""
    return np.cumsum(lengths[ids])


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of it that cross its end). cuts: where sections end, in bytes; the last is the text's end."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(cuts, starts, "right")
    last = np.searchsorted(cuts, ends - 1, "right")
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for i in crossing.tolist():
            edges = np.clip(np.concatenate(([starts[i]], cuts[first[i] : last[i] + 1])), starts[i], ends[i])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(cuts)
    return np.bincount(owner, minlength=n)[:n], np.bincount(first[crossing], minlength=n)[:n]


def section_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "majority") -> DataFrame:
    """(id_col, section int, start long, stop long, n_tokens long, n_crossing long, doc_tokens long): a row for each section.

    Sections end after each separator, and cover the text; start and stop are in characters. n_crossing counts tokens
    that begin in the section and end in a later one. A document's n_tokens add up to doc_tokens. Null and empty texts
    have one empty section; repeated rows are counted each; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    end = separator.encode()
    schema = StructType([docs.schema[id_col], *StructType.fromDDL("section int, start bigint, stop bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint").fields])

    def run(batches):
        encoding, lengths = _encoding(path, pattern)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).cumsum()
            a = 0
            while a < batch.num_rows:  # about 2 MB of text at a time
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 2_000_000, "right")))
                texts = batch.column(1).slice(a, b - a).to_pylist()
                rows, cols = [], [[] for _ in range(6)]
                for text in texts:
                    data = (text or "").encode("utf-8")
                    ids = np.asarray(encoding.encode_ordinary(text or ""), np.int64)
                    raw = np.frombuffer(data, np.uint8)
                    if len(end) == 1:
                        cuts = np.flatnonzero(raw == end[0]) + 1
                    else:
                        cuts, at = [], data.find(end)
                        while at >= 0:
                            cuts.append(at + len(end))
                            at = data.find(end, at + len(end))
                        cuts = np.array(cuts, np.int64)
                    if not len(cuts) or cuts[-1] != len(data):
                        cuts = np.append(cuts, len(data))
                    tokens, crossing = attribute(token_ends(ids, lengths), cuts, rule)
                    stops = np.cumsum((raw & 0xC0) != 0x80)[cuts - 1] if len(raw) else np.zeros(1, np.int64)
                    rows.append(len(cuts))
                    for col, x in zip(cols, (np.arange(len(cuts)), np.concatenate(([0], stops[:-1])), stops, tokens, crossing, np.full(len(cuts), len(ids)))):
                        col.append(x)
                at = pa.array(np.repeat(np.arange(a, b), rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(np.concatenate(c).astype(np.int32 if k == 0 else np.int64)) for k, c in enumerate(cols))], schema.names)
                a = b

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
