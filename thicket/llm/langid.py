"""Language identification: scripts narrow the candidates, then Viterbi over word scores labels spans.

A word's score for a language is the sum of log probabilities of its character n-grams (and of the word itself).
A path through a text's words pays a penalty for every switch of language, so that a passage in another language is
labelled as a span of its own and a stray word isn't. The prediction is the language with the most letters on the
best path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import for_python, memory_returned, staged, with_fields

#: Labelled rows per language that the model is fitted on, at most (about; rows are drawn by a hash of id and text). It
#: bounds the model, too, which keeps all n-grams of those rows.
TRAIN_DOCS_PER_LANG = 2000
SWITCH_PENALTY = 12.0
#: Words whose scores a Python worker remembers, and words that one Viterbi call holds.
MEMO_WORDS, CALL_WORDS = 150_000, 100_000
#: Scores of a step of best_paths() from which arrays are quicker than lists.
FEW = 32

# First code points of scripts' ranges and the script that holds from there on (Unicode blocks).
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Thaana"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE30, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPT_STARTS[int(np.searchsorted(_STARTS, ord(word[0]), "right")) - 1][1]


def grams(word: str) -> list[str]:
    """The word's character trigrams with its edges marked, and the word itself."""
    w = f"<{word}>"
    return [w, *[w[i : i + 3] for i in range(len(w) - 2)]]


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]  # n-gram to its row in weights; the last row is for n-grams that no language has
    weights: np.ndarray
    scripts: dict[str, np.ndarray]  # script to a mask over langs

    def __post_init__(self):
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)
        none = np.ones(len(self.langs), bool)
        self.outside = np.array([np.where(self.scripts.get(s, none), 0.0, 1000.0) for _, s in SCRIPT_STARTS])

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: 0 for the likeliest language, negative for the others."""
        get = self.memo.__getitem__
        new = list(set(words).difference(self.memo))
        if new:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
                self.rows = self.rows[:0]
                new = list(set(words))
            unseen, find = len(self.weights) - 1, self.index.get
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)  # a word has a gram more than letters
            every = map(find, chain.from_iterable(map(grams, new)), repeat(unseen))
            scores = np.add.reduceat(self.weights[np.fromiter(every, np.int64, ends[-1])], np.concatenate(([0], ends[:-1])), axis=0)
            firsts = np.fromiter((ord(w[0]) for w in new), np.int64, len(new))
            scores -= self.outside[np.searchsorted(_STARTS, firsts, "right") - 1]
            scores -= scores.max(axis=1, keepdims=True)
            first = len(self.rows)
            self.rows = np.concatenate([self.rows, scores.astype(np.float32)])
            self.memo.update((w, first + k) for k, w in enumerate(new))
        return self.rows[np.fromiter(map(get, words), np.int64, len(words))]


def _gram_counts(batches):
    """(lang, kind, item, n) of one partition; rows for n-grams, words' scripts and totals."""
    counts: dict[str, Counter] = {}
    scripts: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = Counter(WORD.findall((text or "").lower()))
            own = counts.setdefault(lang, Counter())
            for w, n in words.items():
                scripts[lang, script_of(w)] += n
                for g in grams(w):
                    own[g] += n
    rows = [(lang, "gram", g, n) for lang, c in counts.items() for g, n in c.items()] + [(lang, "script", s, n) for (lang, s), n in scripts.items()]
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string() if i < 3 else pa.int64()) for i in range(4)], ["lang", "kind", "item", "n"])


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_lang: int = TRAIN_DOCS_PER_LANG, id_col: str = "doc_id") -> Model:
    """A model from labelled rows; rows without text or label are left out. No rows: a model without languages.

    Of each language about per_lang rows are read (all, if there are fewer), chosen by a hash of text and id (of the text
    alone, without such a column), so that a text that many rows have counts as often as it is drawn. What comes to the
    driver is the counts of those rows' n-grams.
    """
    drawn = F.pmod(F.xxhash64(text_col, *[c for c in labelled.columns if c == id_col]), F.lit(1_000_000))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), drawn.alias("drawn"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], {}, np.zeros((1, 0)), {})
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1_000_000, math.ceil(1e6 * per_lang / n)))))
    counts = rows.where(F.col("drawn") < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(_gram_counts, "lang string, kind string, item string, n bigint")
    counts = staged(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(totals)
    seen: dict[str, dict[str, int]] = {}
    for r in counts.where("kind = 'script'").collect():
        seen.setdefault(r["item"], {})[r["lang"]] = r["n"]
    table = counts.where("kind = 'gram'").select("lang", "item", "n").toArrow()
    items, names = (table.column(c).combine_chunks().dictionary_encode() for c in ("item", "lang"))
    index = {g: i for i, g in enumerate(items.dictionary.to_pylist())}
    place = items.indices.to_numpy()
    column = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    weights = np.full((len(index) + 1, len(langs)), 0.5)
    weights[place, column] += table.column("n").to_numpy()
    weights = np.log(weights / (weights.sum(axis=0) - 0.5))
    weights[-1] = weights[-1].max()
    words = {lang: sum(c.get(lang, 0) for c in seen.values()) for lang in langs}
    scripts = {s: np.array([c.get(lang, 0) >= 0.01 * max(1, words[lang]) for lang in langs]) for s, c in seen.items()}
    return Model(langs, index, weights, {s: m for s, m in scripts.items() if m.any()})


def best_paths(scores: np.ndarray, lengths: list[int], penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """For each word the language on its text's best path. scores: a row for each word, texts one after the other.

    Where no stretch of a text gains more than one penalty over its best single language, that language is the best
    path; the other texts are walked together, a word of each at a time, longest text first.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))  # holds the number of any language
    path = np.zeros(len(scores), kind)
    walk: list[tuple[int, int]] = []
    if not len(scores):
        return path
    path[:] = np.repeat(np.add.reduceat(scores, starts, axis=0).argmax(axis=1), lengths)
    if scores.shape[1] > 1:
        every, others = np.arange(len(scores)), scores.copy()
        others[every, path] = -np.inf
        more = others.max(axis=1) - scores[every, path]
        # No stretch gains more than all words together that gain.
        most = np.add.reduceat(np.maximum(more, 0), starts, dtype=np.float64)
        for k in np.flatnonzero(most > penalty).tolist():
            a, b = int(starts[k]), int(ends[k])
            gain = np.concatenate(([0.0], np.cumsum(more[a:b])))
            if (gain - np.minimum.accumulate(gain)).max() > penalty:
                walk.append((a, b))
    if not walk:
        return path
    walk.sort(key=lambda x: x[0] - x[1])
    first, length = np.array([a for a, _ in walk]), np.array([b - a for a, b in walk])
    at = np.concatenate(([0], np.cumsum(length)))[:-1]
    came = np.zeros((int(length.sum()), scores.shape[1]), kind)
    value = scores[first].copy()
    own = np.arange(scores.shape[1], dtype=kind)
    few = max(1, FEW // scores.shape[1])  # so few texts are left in the end that a step is quicker without arrays
    alone = int(length[few]) if len(length) > few else 1
    for t, n in zip(range(1, alone), np.searchsorted(-length, -np.arange(1, alone), "left").tolist()):
        v = value[:n]
        top = v.argmax(axis=1)
        switched = v[np.arange(n), top][:, None] - penalty
        stay = v >= switched
        came[at[:n] + t] = np.where(stay, own, top[:, None])
        value[:n] = np.where(stay, v, switched) + scores[first[:n] + t]
    for i, ((a, b), k) in enumerate(zip(walk[:few], at.tolist())):
        v, same = value[i].tolist(), own.tolist()
        rows, froms = scores[a + alone : b].tolist(), []
        for row in rows:
            switched = max(v) - penalty
            if min(v) >= switched:
                froms.append(same)
            else:
                top = v.index(max(v))
                froms.append([j if x >= switched else top for j, x in enumerate(v)])
                v = [x if x >= switched else switched for x in v]
            v = [x + y for x, y in zip(v, row)]
        if froms:
            came[k + alone : k + b - a] = froms
            value[i] = v
    for (a, b), k, v in zip(walk, at.tolist(), value):
        label = int(v.argmax())
        back = came[k : k + b - a]
        for t in range(b - a - 1, -1, -1):
            path[a + t] = label
            label = int(back[t, label])
    return path


def _label(model: Model, texts: list[str | None], spans: bool, penalty: float) -> list[tuple]:
    found = [[(m.start(), m.end()) for m in WORD.finditer(t)] if spans else None for t in texts if t] if spans else None
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    if spans:  # offsets are those of the text as it is
        found = iter(found)
        at = [next(found) if t else [] for t in texts]
        words = [[t[a:b].lower() for a, b in x] for t, x in zip(texts, at)]
    # Roman numerals and the like are word characters, too, but no letters.
    words = [x if any(c.isalpha() for w in x for c in w) else [] for x in words]
    flat = [w for x in words for w in x]
    out: list[tuple] = []
    path = best_paths(model.score(flat), [len(x) for x in words if x], penalty) if flat and model.langs else None
    sizes, k = np.fromiter(map(len, flat), np.int64, len(flat)), 0
    for i, x in enumerate(words):
        if not x or path is None:
            out.append(("und", 0.0, []))
            continue
        p, s = path[k : k + len(x)], sizes[k : k + len(x)]
        k += len(x)
        letters = np.bincount(p, weights=s, minlength=len(model.langs))
        best = int(letters.argmax())
        marks: list = []
        if spans:
            cut = [0, *(np.flatnonzero(np.diff(p.astype(np.int64))) + 1).tolist(), len(p)]
            marks = [{"start": at[i][a][0], "end": at[i][b - 1][1], "lang": model.langs[p[a]]} for a, b in zip(cut, cut[1:])]
        out.append((model.langs[best], float(letters[best] / letters.sum()), marks))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, penalty: float = SWITCH_PENALTY, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred (a language of the model; 'und' for null and texts without letters), score (the share of
    letters on the best path that are in that language; 0 for 'und') and, if asked for, spans: array of
    (start, end, lang) in characters. Nothing but the text is read. Columns of docs with those names are replaced;
    repeated rows get the same result. Ties go to the language that sorts first.
    Without keep_text the text isn't sent back from Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.weights, model.scripts))
    names = ["lang_pred", "score"] + ["spans"] * spans
    given, text_at, back = for_python(docs, text_col, names, keep_text)
    schema = with_fields(given.select(*back), "lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)
    mark = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        with memory_returned():
            yield from labelled(batches)

    def labelled(batches):
        own = Model(*sent.value)
        for b in batches:
            texts = b.column(text_at)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).cumsum()
            a = 0
            while a < b.num_rows:  # some megabytes of text at a time
                z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + 6 * CALL_WORDS, "right")))
                got = _label(own, texts.slice(a, z - a).to_pylist(), spans, penalty)
                cols = [b.column(c).slice(a, z - a) for c in back] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if spans:
                    cols.append(pa.array([g[2] for g in got], mark))
                yield pa.RecordBatch.from_arrays(cols, schema.names)
                a = z

    return given.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
