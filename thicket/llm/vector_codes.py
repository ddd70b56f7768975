"""Compressed codes for vectors: each of a vector's equal parts is replaced by the nearest entry of that part's codebook.

Codebooks are fitted over all vectors, in whole numbers, so that the result doesn't depend on how rows are dealt out. A
round broadcasts a kd-tree of each codebook; tasks look up the nearest entry of every part and send back sums and counts
for each entry and component; what comes to the driver is one number for each component of a codebook.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import broadcast_if, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers beyond this are taken as this, so that squares and their sums fit 64 bits.
MOST = 1 << 26
#: Labels whose sums the last join sends to all tasks, at most, and rows that a task works on at a time.
SENT_LABELS, CALL_ROWS = 100_000, 8192


@dataclass
class _Node:
    """A leaf with the indexes of its entries, or a cut: entries with x[axis] <= at are low, the others (>= at) high."""

    entries: np.ndarray | None = None
    axis: int = 0
    at: int = 0
    low: _Node | None = None
    high: _Node | None = None


def kd_tree(entries: np.ndarray, own: np.ndarray | None = None, leaf: int = 2) -> _Node:
    """A kd-tree over the rows of entries, cut at the median of the widest axis down to leaf entries."""
    own = np.arange(len(entries)) if own is None else own
    x = entries[own]
    spread = x.max(axis=0) - x.min(axis=0) if len(own) else np.zeros(1, np.int64)
    if len(own) <= leaf or not x.shape[1] or not spread.max():
        return _Node(np.sort(own))
    axis = int(spread.argmax())
    order = own[np.argsort(x[:, axis], kind="stable")]
    middle = len(order) // 2
    return _Node(None, axis, int(entries[order[middle], axis]), kd_tree(entries, order[:middle], leaf), kd_tree(entries, order[middle:], leaf))


def nearest(tree: _Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of points the index of its nearest entry, the lowest of equally near ones, and the squared distance.

    Branch and bound over all points at once: a point goes down its own side first, and to the other side if the cut is
    no farther than its best entry so far. Where it is exactly as far, an entry there may tie with a lower index.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(entries))

    def visit(node: _Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            for e in node.entries.tolist():
                far = ((points[rows] - entries[e]) ** 2).sum(axis=1)
                closer = (far < best[rows]) | ((far == best[rows]) & (e < index[rows]))
                best[rows[closer]], index[rows[closer]] = far[closer], e
            return
        gap = points[rows, node.axis] - node.at
        below = gap < 0
        visit(node.low, rows[below])
        visit(node.high, rows[~below])
        for rest, side in ((node.high, below), (node.low, ~below)):
            back = rows[side]
            visit(rest, back[gap[side] ** 2 <= best[back]])

    visit(tree, np.arange(len(points)))
    return index, best


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, x): components as whole numbers floor(SCALE * component), of the vectors that are kept."""
    v = F.col(vec_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST / SCALE)), F.lit(-MOST / SCALE)) * SCALE).cast("int")).alias("x"))


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector of this many components begin and end."""
    return [size * i // parts for i in range(parts + 1)]


def _points(column: pa.Array, at: list[int]) -> list[np.ndarray]:
    x = np.asarray(column.flatten(), np.int64).reshape(len(column), at[-1])
    return [np.ascontiguousarray(x[:, a:b]) for a, b in zip(at, at[1:])]


def _slices(batches, column: int):
    for b in batches:
        for a in range(0, b.num_rows, CALL_ROWS):
            part = b.slice(a, CALL_ROWS)
            yield part, part.column(column)


def _moved(rows: DataFrame, books: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """books after one round: each entry the floor of the mean of its points; entries without points stay."""
    sent = rows.sparkSession.sparkContext.broadcast([(kd_tree(b), b) for b in books])

    def sums(batches):
        total = [np.zeros(b.shape, np.int64) for _, b in sent.value]
        count = [np.zeros(len(b), np.int64) for _, b in sent.value]
        for _, column in _slices(batches, 0):
            for k, x in enumerate(_points(column, at)):
                index, _ = nearest(*sent.value[k], x)
                np.add.at(total[k], index, x)
                count[k] += np.bincount(index, minlength=len(count[k]))
        found = [(k, e, p, int(total[k][e, p]), int(count[k][e])) for k in range(len(total)) for e in np.flatnonzero(count[k]).tolist() for p in range(total[k].shape[1])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["k", "e", "p", "total", "n"])

    found = rows.select("x").mapInArrow(sums, "k bigint, e bigint, p bigint, total bigint, n bigint").groupBy("k", "e", "p").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = [b.copy() for b in books]
    for r in found.collect():  # a row for each component of the codebooks
        moved[r["k"]][r["e"], r["p"]] = r["total"] // r["n"]
    sent.unpersist()
    return moved


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of whole_vectors() of this size: they start as the parts of the vectors with the smallest ids, and
    each round takes every vector into account. Without vectors they have no entry."""
    seeds = rows.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries)
    x = np.array([r["x"] for r in seeds.collect()], np.int64).reshape(-1, size)
    at = cuts(size, parts)
    books = [x[:, a:b].copy() for a, b in zip(at, at[1:])]
    for _ in range(rounds if len(x) else 0):
        books = _moved(rows, books, at)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row for each vector that is kept.

    code is the indexes of its parts' nearest entries, two hex digits each, error the squared distances to them, summed;
    label_error the errors of all vectors of a label, summed, null being a label, too; codebooks_sha256 the SHA-256 of all
    entries' components by part, entry and position, comma-joined. decoded() gives the vectors back.

    Left out are vectors that are null, hold null or non-finite components, or have another length than most (the smaller
    on a tie). Repeated rows are coded each; of rows with one id the smallest vector can start an entry; null ids start
    none (where no vector has an id, the result is empty). Components beyond MOST are taken as MOST. Lengths that parts
    don't divide are cut as evenly as can be. Other columns are ignored, whatever their names. entries is 256 at most.
    """
    spark = vectors.sparkSession
    rows = staged(whole_vectors(vectors, id_col, vec_col, label_col), "vectors")
    top = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if top is None:
        return spark.createDataFrame([], schema)
    size = top["size"]
    rows, at = rows.where(F.size("x") == size), cuts(size, parts)
    books = fit(rows, size, parts, entries, rounds)
    if not len(books[0]):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast([(kd_tree(b), b) for b in books])

    def coded(batches):
        for part, column in _slices(batches, 2):
            error, codes = np.zeros(len(column), np.int64), np.zeros((len(column), parts), np.uint8)
            for k, x in enumerate(_points(column, at)):
                codes[:, k], far = nearest(*sent.value[k], x)
                error += far
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    codes = staged(rows.mapInArrow(coded, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    sums = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "own")
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.flatten().tolist()).encode()).hexdigest()
    out = codes.join(broadcast_if(sums, sums.count(), SENT_LABELS), F.col("label").eqNullSafe(F.col("own")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """codes with vector (array<double>): the entries that a code stands for, put together; null for a null code.
    A column of that name is replaced. books are what fit() gave."""
    sent = codes.sparkSession.sparkContext.broadcast([b / SCALE for b in books])

    @F.pandas_udf("array<double>")
    def back(code):
        return code.map(lambda c: None if c is None else np.concatenate([b[i] for b, i in zip(sent.value, bytes.fromhex(c))]).tolist())

    return codes.withColumn("vector", back(F.col(code_col)))
