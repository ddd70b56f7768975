"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised apart, each by its own codebook, so K centroids a half make K * K cells. A
query walks the pairs of centroids by the sum of its distances to both, with a heap, until the cells met hold the
asked share of the vectors; what is in them is ranked by the exact distance. Codebooks are fitted on a bounded sample;
every vector is in the index.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm._shared import staged

#: Rows that the codebooks are fitted on at most (about; drawn by a hash of the id), rounds of fitting, centroids a half.
SAMPLE_ROWS, ROUNDS, CENTROIDS = 20_000, 12, 64
#: The share of the vectors whose cells a query visits is measured: the one that finds RECALL of the nearest neighbours of
#: TRIALS queries, or what is given. Vectors without clusters need a large one. Queries visit LEAST vectors at least.
RECALL, TRIALS, LEAST = 0.97, 128, 2000
#: A ranking call holds about BLOCK_ROWS vectors (up to twice as many) and QUERY_ROWS queries, whatever the tables' sizes.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048


def codebook(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centroids of the rows of x; fewer if x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 8192):
        part = x[at : at + 8192]
        out[at : at + 8192] = ((c**2).sum(axis=1) - 2 * part @ c.T).argmin(axis=1)
    return out


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) by first[i] + second[j], from the smallest, until they hold enough vectors.

    The multi-sequence walk: a pair comes on the heap when both pairs before it have left it.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, left, out, held = [(first[a[0]] + second[b[0]], 0, 0)], np.zeros((len(a) + 1, len(b) + 1), bool), [], 0
    left[-1, :] = left[:, -1] = True  # beyond the edges: also what index -1 reads
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        left[i, j] = True
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if i + 1 < len(a) and left[i + 1, j - 1]:
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and left[i - 1, j + 1]:
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


def reached(first: np.ndarray, second: np.ndarray, counts: np.ndarray, cells: list[int]) -> list[int]:
    """How many vectors a walk has met when it has met each of these cells."""
    held = np.cumsum(counts[(order := np.array(walk(first, second, counts, int(counts.sum()))))])
    at = {int(c): int(n) for c, n in zip(order, held)}
    return [at[c] for c in cells]


def measured_share(index: DataFrame, trials: DataFrame, books: list[np.ndarray], counts: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The least share of the vectors of index (v, ids, cell) with which this much of the k nearest neighbours of trials
    (query_id, v: TRIALS rows at most) is found. All vectors are looked at, for these few queries; each task sends back the
    k nearest of each query that it has."""
    asked = trials.collect()
    if not asked:
        return 1.0
    half, size = books[0].shape[1], len(asked[0]["v"])
    ids, q = np.array([r["query_id"] for r in asked]), np.array([r["v"] for r in asked], float)
    sent = index.sparkSession.sparkContext.broadcast((ids, q))

    def near(batches):
        own, x = sent.value
        best: list[list[tuple]] = [[] for _ in own]
        for b in batches:
            v, cell, first = _matrix(pa.chunked_array([b.column(0)]), size), b.column(1).to_numpy(), b.column(2).to_pylist()
            for at in range(0, len(v), 2048):
                part = v[at : at + 2048]
                far = (x**2).sum(axis=1)[:, None] - 2 * x @ part.T + (part**2).sum(axis=1)
                for i in range(len(own)):
                    for j in np.argpartition(far[i], min(k, len(part) - 1))[: k + 1].tolist():
                        best[i] += [(float(far[i, j]), int(cell[at + j])) for d in first[at + j] if d != own[i]]
                    best[i] = heapq.nsmallest(k, best[i])
        rows = [(i, f, c) for i, found in enumerate(best) for f, c in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], ["i", "far", "cell"])

    found = index.select("v", "cell", "ids").mapInArrow(near, "i int, far double, cell int")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("far", "cell"))).where(F.col("r") <= k).collect()
    held: dict[int, list[int]] = {}
    for r in found:
        held.setdefault(r["i"], []).append(r["cell"])
    needs = sorted(n for i, cells in held.items() for n in reached(((books[0] - q[i, :half]) ** 2).sum(axis=1), ((books[1] - q[i, half:]) ** 2).sum(axis=1), counts, cells))
    return needs[min(len(needs) - 1, math.ceil(recall * len(needs)) - 1)] / counts.sum() if needs else 1.0


def usable(vectors: DataFrame, id_col: str, vec_col: str, size: int | None = None) -> DataFrame:
    """(vec_id, v): ids and vectors that take part: not null, not empty, not zero, all components finite, of size
    components (None: as many as most vectors have, fewer on a tie). Repeated rows count once."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rows = rows.where(good)
    if size is None:
        top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = top["n"] if top else 0
    return rows.where(F.size("v") == size).dropDuplicates(["vec_id", "v"])


def _matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists of size numbers, as rows."""
    return np.asarray(column.combine_chunks().flatten(), float).reshape(-1, size)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank int, vec_id, score double): for each query its k nearest among the vectors of the cells it visits,
    by Euclidean distance in double precision, its own id left out; ties go to the smaller id. share is that of the
    vectors that a query visits (1: exact); by default it is measured on some of the queries.

    queries has rows of vectors' columns. Vectors that are null, zero, or hold null or non-finite components take no
    part, as queries or candidates; nor do those of another length than most of vectors have. Where many ids share one
    vector, the k + 1 smallest stand for it: no other could be among a query's k nearest. Without vectors or queries the
    result is empty. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vec_col), "vectors")
    total = rows.count()
    out_schema = "query_id bigint, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = rows.select(F.size("v")).first()[0]
    part = min(1_000_000, math.ceil(1e6 * sample_rows / total))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < part).limit(2 * sample_rows)
    sample = np.concatenate([_matrix(x.select("v").toArrow().column(0), size) for x in (drawn, rows.limit(1))])
    half = sample.shape[1] // 2
    books = [codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids)] if half else [np.zeros((1, 0)), codebook(sample, centroids)]
    width = len(books[1])

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, sample.shape[1]))
        return pd.Series((nearest(x[:, :half], books[0]) if half else 0) * width + nearest(x[:, half:], books[1]))

    # Ranks are cut in each task before rows are dealt, so a vector that very many ids share is no burden.
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    rows = rows.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    index = staged(rows.withColumn("cell", cell_of("v")), "multiindex")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most as many as there are cells
        counts[r["cell"]] = r["count"]
    asked = staged(usable(queries, id_col, vec_col, size).select(F.col("vec_id").alias("query_id"), "v"), "queries")
    n_asked = asked.count()
    if share is None and counts.sum() > LEAST:
        trials = asked.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(1_000_000)) < math.ceil(2e6 * TRIALS / max(1, n_asked))).orderBy(F.xxhash64("query_id", "v")).limit(TRIALS)
        share = measured_share(index, trials, books, counts, k)
    enough = max(math.ceil((share or 1) * counts.sum()), LEAST)
    blocks = max(1, math.ceil(counts.sum() / BLOCK_ROWS))
    block_of = np.searchsorted(np.cumsum(counts), np.arange(1, blocks) * (counts.sum() / blocks), "left")

    @F.pandas_udf("array<struct<block:int,cells:array<int>>>")
    def visits(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            x = np.asarray(x, float)
            cells = np.array(walk(((books[0] - x[:half]) ** 2).sum(axis=1), ((books[1] - x[half:]) ** 2).sum(axis=1), counts, enough))
            at = np.searchsorted(block_of, cells, "left")
            out.append([{"block": int(b), "cells": cells[at == b].tolist()} for b in np.unique(at)])
        return pd.Series(out)

    # Cells in order, cut to blocks of about BLOCK_ROWS; a cell larger than that is dealt to several parts.
    edges = [0, *(block_of + 1).tolist(), len(counts)]
    subs = np.array([max(1, math.ceil(counts[a:b].sum() / (2 * BLOCK_ROWS))) for a, b in zip(edges, edges[1:])])

    @F.pandas_udf("struct<block:int,sub:int>")
    def dealt(cell: pd.Series, salt: pd.Series) -> pd.DataFrame:
        b = np.searchsorted(block_of, cell.to_numpy(), "left")
        return pd.DataFrame({"block": b.astype("int32"), "sub": (salt.to_numpy() % subs[b]).astype("int32")})

    @F.pandas_udf("array<int>")
    def parts(block: pd.Series) -> pd.Series:
        return pd.Series([list(range(subs[b])) for b in block])

    slices = max(1, math.ceil(n_asked / QUERY_ROWS))
    # Vectors in blocks against queries in slices; a query goes to the blocks that it visits only.
    left = index.withColumn("at", dealt("cell", F.pmod(F.xxhash64("v"), F.lit(1 << 20))))
    left = left.select("at.block", "at.sub", "cell", "v", "ids", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
    asked = asked.select("query_id", "v", "slice", F.explode(visits("v")).alias("w")).select("query_id", "v", "slice", "w.block", "w.cells")
    asked = asked.withColumn("sub", F.explode(parts("block")))

    def rank(members: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple] = []
        if len(members) and len(questions):
            members = members.sort_values("cell", kind="stable")
            x, cell, ids = np.stack(members["v"].to_numpy()), members["cell"].to_numpy(), members["ids"].to_numpy()
            for q, v, cells in zip(questions["query_id"], questions["v"], questions["cells"]):
                rows_ = np.flatnonzero(np.isin(cell, cells))
                if not len(rows_):
                    continue
                score = np.sqrt(((x[rows_] - np.asarray(v, float)) ** 2).sum(axis=1))
                # The k + 1 smallest and what is equal to the last of them: ids decide.
                last = np.partition(score, min(k, len(score) - 1))[min(k, len(score) - 1)]
                close = [(float(score[i]), int(d)) for i in np.flatnonzero(score <= last) for d in ids[rows_[i]] if d != q]
                got += [(int(q), d, s) for s, d in heapq.nsmallest(k, close)]
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("block", "sub", "slice").cogroup(asked.groupBy("block", "sub", "slice")).applyInPandas(rank, out_schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
