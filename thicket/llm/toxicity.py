"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words are read in overlapping windows. A word comes in as two vectors, summed: one for the word, where it is
in the vocabulary, and the mean of those of its character n-grams, so that a spelling never met still says something.
Two gated recurrent layers, one from either end, run over the window; attention weighs their states, and what they come
to gives the window's logit. A text is as toxic as its most toxic window. Trained in numpy, by Adam, on a bounded
sample: the gradient of a text is that of its highest window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import memory_returned, unused, with_fields

#: The sample: rows of each label at most (drawn by a hash of the id), and bytes of the texts that take part in it.
TRAIN_ROWS_PER_LABEL, TRAIN_TEXT_BYTES = 1500, 6_000
#: Words of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 32, 24
#: Words of the vocabulary at most, rows for character n-grams, their lengths in bytes, width of inputs and states.
VOCABULARY, GRAM_ROWS, GRAM_LENGTHS, INPUT, STATE = 20_000, 1 << 16, (3, 4, 5), 8, 8
STEPS, TEXTS_PER_STEP, RATE, INPUT_RATE, WORD_DROP = 300, 32, 0.01, 0.03, 0.3
#: Words and n-grams start with how far their number of toxic texts is from what chance gives, in standard deviations;
#: up to NOISE counts as chance.
NOISE, MOST_TOLD = 2.5, 3.0
THRESHOLD = 0.7
#: Bytes of text that a scoring call reads about, and windows that run through the network at a time.
CALL_BYTES, CALL_WINDOWS = 1 << 20, 2048

_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


# --- words --------------------------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def split_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of texts that lie one after the other in data, in lower case: runs of a-z,
    0-9 and bytes beyond ASCII."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cut = np.unique(ends[(ends > 0) & (ends < len(data))])
    begins[cut] |= inside[cut]
    stops[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(ends, start, "right")


@dataclass
class Words:
    """The distinct words of some texts: digests, and the rows of their character n-grams, one word after the other."""

    digest: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words, and for each word the number of its distinct one. A word's digest is a polynomial of its bytes
    modulo 2**64, as all n-grams' are; its edges are marked, so that n-grams know where it begins and ends."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    digest, at, own = np.unique((total[end] - total[start]) * _powers(_INVERSE, len(data))[start], return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    # The distinct words' bytes, each between two marks.
    size = end - start + 2
    stop = np.cumsum(size)
    marked = np.full(int(stop[-1]) if len(stop) else 0, 255, np.uint8)
    inner = np.ones(len(marked), bool)
    inner[stop - 1] = inner[stop - size] = False
    shift = np.repeat(start - (stop - size) - 1, size)
    marked[inner] = data[(np.arange(len(marked)) + shift)[inner]]
    left = np.repeat(stop, size) - np.arange(len(marked))  # bytes to the end of the word
    rows, owner = [], []
    word = np.repeat(np.arange(len(size)), size)
    codes = marked.astype(np.uint64) + np.uint64(1)
    for n in GRAM_LENGTHS:
        whole = np.flatnonzero(left >= n)
        h = np.full(len(whole), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(_BASE) + codes[whole + k]
        rows.append((_mixed(h) >> np.uint64(40)) % np.uint64(GRAM_ROWS))
        owner.append(word[whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(size))
    return Words(digest, np.concatenate(rows)[order].astype(np.int64), np.cumsum(count) - count, count), own.reshape(-1)


def windows(words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of every window, text after text: each STRIDE words one of WINDOW words begins, until one
    reaches the text's end. A text without words has one window without words."""
    n = np.maximum(1, -(-(words_of - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), n)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    first = np.repeat(np.cumsum(words_of) - words_of, n) + offset
    return first, np.minimum(WINDOW, words_of[text] - offset), text


# --- network ------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def told(texts: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """What it says of a text that something is in it, from the number of texts that have it and of toxic ones."""
    z = (toxic - texts * rate) / np.sqrt(texts * rate * (1 - rate) + 1)
    return np.clip(np.sign(z) * np.maximum(np.abs(z) - NOISE, 0) / 2, -MOST_TOLD, MOST_TOLD)


def start_weights(words: int, seed: int = 0) -> dict[str, np.ndarray]:
    """word, gram: input vectors; per direction in_, state, bias: update, reset and new state beside each other."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    w = {"word": draw(words + 1, INPUT, by=0.01), "gram": draw(GRAM_ROWS, INPUT, by=0.01), "look": draw(2 * STATE, by=0.3), "out": draw(2 * STATE, by=0.3), "shift": np.full(1, -1, np.float32)}
    for side in ("f", "b"):
        w |= {f"in_{side}": draw(INPUT, 3 * STATE, by=INPUT**-0.5), f"state_{side}": draw(STATE, 3 * STATE, by=STATE**-0.5), f"bias_{side}": np.zeros(3 * STATE, np.float32)}
    w["word"][-1] = 0  # no word
    return w


def run_layer(x: np.ndarray, state: np.ndarray, live: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of a gated recurrent layer, (steps, windows, STATE). x: projected inputs (steps, windows, 3 * STATE) with the
    bias; where live is false the state stays. keep: also what the gradient needs."""
    steps, n, _ = x.shape
    h, out, kept = np.zeros((n, STATE), x.dtype), np.empty((steps, n, STATE), x.dtype), []
    for t in range(steps):
        s = h @ state
        gates = _sigmoid(x[t, :, : 2 * STATE] + s[:, : 2 * STATE])
        z, r = gates[:, :STATE], gates[:, STATE:]
        if live is not None:
            z = np.where(live[t][:, None], z, 1)
        new = np.tanh(x[t, :, 2 * STATE :] + r * s[:, 2 * STATE :])
        if keep:
            kept.append((h, z, r, new, s[:, 2 * STATE :]))
        h = new + z * (h - new)
        out[t] = h
    return out, kept


def pooled(f: np.ndarray, b: np.ndarray, w: dict, live: np.ndarray | None) -> tuple[np.ndarray, tuple]:
    """Windows' logits from the states of both layers, and what the gradient needs."""
    scores = f @ w["look"][:STATE] + b @ w["look"][STATE:]
    if live is not None:
        scores = np.where(live, scores, -1e9)
    weight = np.exp(scores - scores.max(axis=0))
    weight /= weight.sum(axis=0)
    context = np.concatenate(((weight[..., None] * f).sum(axis=0), (weight[..., None] * b).sum(axis=0)), axis=1)
    return context @ w["out"] + w["shift"][0], (weight, context)


def layer_gradient(dout: np.ndarray, kept: list, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the projected inputs, of the state matrix), from that of the states."""
    dx, dstate, dh = np.zeros((*dout.shape[:2], 3 * STATE), dout.dtype), np.zeros_like(state), np.zeros(dout.shape[1:], dout.dtype)
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, new, s = kept[t]
        dh = dh + dout[t]
        dz = dh * (h - new) * z * (1 - z)
        dnew = dh * (1 - z) * (1 - new * new)
        dr = dnew * s * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dnew), axis=1)
        ds = np.concatenate((dz, dr, dnew * r), axis=1)
        dstate += h.T @ ds
        dh = dh * z + ds @ state.T
    return dx, dstate


def forward(w: dict, x: np.ndarray, live: np.ndarray | None, keep: bool = False):
    """Windows' logits from their words' input vectors x (steps, windows, INPUT)."""
    f, kept_f = run_layer(x @ w["in_f"] + w["bias_f"], w["state_f"], live, keep)
    back = None if live is None else live[::-1]
    b, kept_b = run_layer(x[::-1] @ w["in_b"] + w["bias_b"], w["state_b"], back, keep)
    logits, rest = pooled(f, b[::-1], w, live)
    return logits, (f, b[::-1], kept_f, kept_b, *rest)


def gradient(w: dict, x: np.ndarray, state: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights (but those of the input vectors), and of x."""
    f, b, kept_f, kept_b, weight, context = state
    g = {"out": context.T @ dlogit, "shift": dlogit.sum(keepdims=True)}
    dcontext = dlogit[:, None] * w["out"]
    both = np.concatenate((f, b), axis=2)
    dweight = (both * dcontext).sum(axis=2)
    dscore = weight * (dweight - (weight * dweight).sum(axis=0))
    g["look"] = (both * dscore[..., None]).sum(axis=(0, 1))
    dboth = weight[..., None] * dcontext + dscore[..., None] * w["look"]
    df, g["state_f"] = layer_gradient(dboth[..., :STATE], kept_f, w["state_f"])
    db, g["state_b"] = layer_gradient(dboth[::-1, :, STATE:], kept_b, w["state_b"])
    db = db[::-1]
    for side, d in (("f", df), ("b", db)):
        g[f"in_{side}"] = np.tensordot(x, d, ((0, 1), (0, 1)))
        g[f"bias_{side}"] = d.sum(axis=(0, 1))
    return g, df @ w["in_f"].T + db @ w["in_b"].T


# --- model --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """vocabulary: sorted digests of the words with a vector of their own. weights is None where there was nothing to
    tell apart; then every score is rate."""

    vocabulary: np.ndarray
    weights: dict[str, np.ndarray] | None
    rate: float

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of distinct words, and of no word in the last row."""
        w, n = self.weights, len(words.digest)
        x = np.zeros((n + 1, INPUT), np.float32)
        if n:
            x[:n] = np.add.reduceat(w["gram"][words.grams], words.first, axis=0) / words.count[:, None]
            x[:n] += w["word"][self.places(words.digest)]
        return x

    def places(self, digest: np.ndarray) -> np.ndarray:
        """Their rows in word; the last one for words that aren't in the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, digest), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == digest if len(self.vocabulary) else np.zeros(len(digest), bool)
        return np.where(known, at, len(self.vocabulary))

    def logits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each text's highest window. data: the texts' UTF-8 bytes in lower case; ends: where they end."""
        start, end, text = split_words(data, ends)
        words_of = np.bincount(text, minlength=len(ends))
        words, own = distinct_words(data, start, end)
        x = self.inputs(words)
        w = self.weights
        projected = {s: x @ w[f"in_{s}"] + w[f"bias_{s}"] for s in ("f", "b")}
        first, size, of = windows(words_of)
        own = np.concatenate((own, np.full(WINDOW, len(x) - 1)))
        found, step = np.empty(len(first), np.float32), np.arange(WINDOW)[:, None]
        full = np.flatnonzero(size == WINDOW)
        for part in [*np.split(full, range(CALL_WINDOWS, len(full), CALL_WINDOWS)), *np.split(rest := np.flatnonzero(size < WINDOW), range(CALL_WINDOWS, len(rest), CALL_WINDOWS))]:
            if not len(part):
                continue
            live = None if size[part[0]] == WINDOW else step < np.maximum(size[part], 1)
            at = own[np.minimum(first[part] + step, len(own) - 1)]
            if live is not None:
                at[:] = np.where(step < size[part], at, len(x) - 1)
            f, _ = run_layer(projected["f"][at], w["state_f"], live)
            b, _ = run_layer(projected["b"][at[::-1]], w["state_b"], None if live is None else live[::-1])
            found[part], _ = pooled(f, b[::-1], w, live)
        return np.maximum.reduceat(found, np.flatnonzero(np.diff(of, prepend=-1)))


    def long_logit(self, data: np.ndarray) -> float:
        """The highest window of one long text, of which only some CALL_BYTES are worked on at a time. A piece gives its
        whole windows, and the next piece begins with the next window. Words beyond CALL_BYTES are cut there."""
        at, take, best = 0, CALL_BYTES, -np.inf
        while True:
            piece = data[at : at + take]
            start, end, _ = split_words(piece, np.array([len(piece)]))
            if at + take >= len(data):
                return max(best, float(self.logits(piece, np.array([len(piece)]))[0]))
            whole = (len(start) - 1 - WINDOW) // STRIDE + 1  # the last word may go on
            if whole < 1:
                take *= 2
                continue
            stop = end[(whole - 1) * STRIDE + WINDOW - 1]
            best = max(best, float(self.logits(piece[:stop], np.array([stop]))[0]))
            at, take = at + int(start[whole * STRIDE]), CALL_BYTES


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 0) -> Model:
    """A model from texts, in lower case, with labels 0 or 1. A step takes as many texts of either label; as its cost doesn't depend on
    the sample's size, neither does the number of steps."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), None, float(y.mean()) if len(y) else 0.0)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    start, end, text = split_words(data, ends)
    words_of = np.bincount(text, minlength=len(raw))
    words, own = distinct_words(data, start, end)
    pairs = np.unique(own.astype(np.int64) * len(raw) + text)  # (word, text), once each
    word, holder = pairs // len(raw), pairs % len(raw)
    texts_with, toxic_with = np.bincount(word, minlength=len(words.digest)), np.bincount(word, y[holder], len(words.digest))
    common = np.flatnonzero(texts_with >= 3)
    common = common[np.argsort(-texts_with[common], kind="stable")][:VOCABULARY]
    common = common[np.argsort(words.digest[common])]
    model = Model(words.digest[common], start_weights(len(common), seed), float(y.mean()))
    w, places = model.weights, np.append(model.places(words.digest), len(common))
    w["word"][:-1, 0] = told(texts_with[common], toxic_with[common], model.rate)
    n = words.count[word]
    held = words.grams[np.arange(n.sum()) + np.repeat(words.first[word] - np.cumsum(n) + n, n)]
    pairs = np.unique(held * len(raw) + np.repeat(holder, n))
    gram, holder = pairs // len(raw), pairs % len(raw)
    w["gram"][:, 0] = told(np.bincount(gram, minlength=GRAM_ROWS), np.bincount(gram, y[holder], GRAM_ROWS), model.rate)
    own = np.append(own, len(words.digest))
    first, size, of = windows(words_of)
    begin = np.searchsorted(of, np.arange(len(raw) + 1))
    rng, step = np.random.default_rng(seed), np.arange(WINDOW)[:, None]
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for turn in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(s, TEXTS_PER_STEP // 2) for s in sides])
        wins = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in drawn])
        whose = np.repeat(np.arange(len(drawn)), begin[drawn + 1] - begin[drawn])
        live = step < np.maximum(size[wins], 1)
        at = np.where(step < size[wins], own[np.minimum(first[wins] + step, len(own) - 1)], len(words.digest))
        met, at = np.unique(at, return_inverse=True)
        at = at.reshape(WINDOW, -1)
        real = met < len(words.digest)
        named = np.where(real & (rng.random(len(met)) >= WORD_DROP), places[met], len(common))
        count = np.where(real, words.count[np.minimum(met, len(words.count) - 1)], 0)
        owner = np.repeat(np.arange(len(met)), count)
        grams = words.grams[np.arange(len(owner)) + np.repeat(words.first[np.where(real, met, 0)] - np.cumsum(count) + count, count)]
        share = (1 / np.maximum(count, 1))[:, None].astype(np.float32)
        x = np.zeros((len(met), INPUT), np.float32)
        x[real] = np.add.reduceat(w["gram"][grams], (np.cumsum(count) - count)[real], axis=0)
        x = x * share + w["word"][named]
        logits, _ = forward(w, x[at], live)
        # The highest window of each text learns; of clean ones all are clean, so its highest is the one most wrong.
        order = np.lexsort((-logits, whose))
        top = order[np.flatnonzero(np.diff(whose[order], prepend=-1))]
        given, on = x[at[:, top]], live[:, top]
        logits, state = forward(w, given, on, keep=True)
        g, dx = gradient(w, given, state, ((_sigmoid(logits) - y[drawn]) / len(drawn)).astype(np.float32))
        dwords = np.zeros_like(x)
        np.add.at(dwords, at[:, top].reshape(-1), dx.reshape(-1, INPUT))
        touched, row = np.unique(grams, return_inverse=True)
        dgrams = np.zeros((len(touched), INPUT), np.float32)
        np.add.at(dgrams, row, (dwords * share)[owner])
        kept = named < len(common)
        rows = {k: slice(None) for k in g} | {"word": named[kept], "gram": touched}
        g["word"], g["gram"] = dwords[kept], dgrams
        for k, d in g.items():  # input vectors that no word has asked for stay
            r, (m, v) = rows[k], moments[k]
            rate = RATE * min(1, 2 * (1 - (turn - 1) / steps)) * (INPUT_RATE if k in ("word", "gram") else 1)
            m[r] += 0.1 * (d - m[r])
            v[r] += 0.01 * (d * d - v[r])
            w[k][r] -= rate * (m[r] / (1 - 0.9**turn)) / (np.sqrt(v[r] / (1 - 0.99**turn)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_label: int = TRAIN_ROWS_PER_LABEL) -> Model:
    """A model from docs whose ids have a label 0 or 1 in labels (the greatest, where an id has several).

    About per_label ids of each label take part, drawn by a hash, of those whose text has TRAIN_TEXT_BYTES at most; of
    repeated ids, per_label rows a label at most. Null texts are empty. With labels of one kind only, every score is that
    label; without any it is 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("own")).agg(F.max(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0)
    for y, n in totals.items():
        share = F.when(F.col("y") == y, F.lit(min(1_000_000, -(-1_000_000 * per_label // n)))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.col("own").cast("string")), F.lit(1_000_000)) < share)
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("own"), text.alias("text")).where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    rows = rows.join(F.broadcast(drawn), "own").withColumn("at", F.xxhash64(F.col("own").cast("string"), "text"))  # drawn has some 2 * per_label rows
    found = [r for y in sorted(totals) for r in rows.where(F.col("y") == y).orderBy("at", "text").limit(per_label).select("text", "y").collect()]
    return train([r["text"] for r in found], [r["y"] for r in found])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score (double, 0 to 1: the text's most toxic window) and predicted (int, 1 from threshold on).

    Only the text is read; null texts and those without words have one window without words. Columns of docs with those
    names are replaced; repeated rows get the same score. Without keep_text the text isn't sent back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "predicted"]
    back = [c for c in docs.columns if c not in names and (keep_text or c != text_col)]
    given, text_at = docs.select(*back, F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(unused("lower", back))), len(back)
    schema = with_fields(given.select(*back), "score double, predicted int")

    def run(batches):
        with memory_returned(), np.errstate(over="ignore"):
            yield from scored(batches)

    def scored(batches):
        own = sent.value
        for b in batches:
            texts = b.column(text_at)
            size = np.asarray(pc.binary_length(texts), np.int64).cumsum()
            wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            begins = int(np.frombuffer(texts.buffers()[1], wide)[texts.offset]) if b.num_rows else 0
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            a = 0
            while a < b.num_rows:  # about CALL_BYTES of whole texts at a time, or one longer text
                z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CALL_BYTES, "right")))
                before = int(size[a - 1]) if a else 0
                p = np.full(z - a, own.rate)
                if own.weights is not None:
                    data = raw[begins + before : begins + int(size[z - 1])]
                    top = own.logits(data, size[a:z] - before) if len(data) <= 2 * CALL_BYTES else np.array([own.long_logit(data)])
                    p = np.round(_sigmoid(top.astype(float)), 5)  # sums in float32 depend on what else is in a call
                cols = [b.column(i).slice(a, z - a) for i in range(text_at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], schema.names)
                a = z

    return given.mapInArrow(run, schema)
