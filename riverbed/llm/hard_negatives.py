"""Hard negatives for anchors, by product quantisation with rigorous bounds.

Vectors become integers; a code of one byte for every few components stands for the nearest of 256 centroids, and the
distance to it, the residual norm, is stored for each group of components. An anchor's lookup tables give the score of a
code; by Cauchy and Schwarz the true score is at most the sum of (anchor norm x residual norm) away. Only rows whose
interval could put them among the results have their integers multiplied. Rows stand in blocks; anchors stream past each
block, and only the few best of a block leave it. First the positives are found so, then the negatives of each window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm.common import materialize

#: Rows at most that the centroids are fitted to; the index holds all rows.
FIT_ROWS = 16_384
#: Components that share a byte of the code, centroids, and rounds of the fit.
WIDTH, CENTROIDS, ROUNDS = 2, 256, 8
#: Rows of a block: in proportion to the root of their number, between these bounds, so that neither blocks nor their results get too many.
BLOCK_ROWS = (4_096, 131_072)
#: Anchors that are scored together, and integers of pairs that are multiplied at once.
ANCHORS, PAIR_CELLS = 64, 1 << 22
SCALE = 256


@dataclass(frozen=True)
class Codebook:
    """``centroids[m, k]``: the k-th centroid of the m-th group of components."""

    centroids: np.ndarray

    def split(self, v: np.ndarray) -> np.ndarray:
        m, _, width = self.centroids.shape
        out = np.zeros((len(v), m * width))
        out[:, : v.shape[1]] = v
        return out.reshape(len(v), m, width)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms, rounded up, of integer vectors."""
        parts = self.split(v)
        codes, norms = np.empty(parts.shape[:2], np.uint8), np.empty(parts.shape[:2], np.float32)
        for m, c in enumerate(self.centroids):
            x = parts[:, m]
            codes[:, m] = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            norms[:, m] = np.sqrt(((x - c[codes[:, m]]) ** 2).sum(1))
        return codes, np.nextafter(norms * np.float32(1 + 1e-6), np.float32(np.inf))

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lookup tables ``[a, m, k]`` and norms ``[a, m]`` of anchors."""
        parts = self.split(anchors)
        return np.einsum("amw,mkw->amk", parts, self.centroids), np.sqrt((parts**2).sum(2))


def integers(embedding):
    """``floor(256 * x)`` of each component as a long; x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: integer vectors of rows that have an id, a label and finite components.

    Of rows that share an id one counts: that of the smallest label, then vector.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))  # NaN is larger than all numbers
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers("embedding").alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(size) and (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def fit(rows: DataFrame, most: int = FIT_ROWS) -> Codebook:
    """Centroids by k-means in each group of components, from at most ``most`` rows chosen by a hash of their id."""
    sample = rows.orderBy(F.xxhash64("vec_id")).select("v").limit(most).collect()
    width = max([1, *(len(r[0]) for r in sample)])
    v = np.zeros((len(sample), width))
    for k, (x,) in enumerate(sample):
        v[k, : len(x)] = x
    groups = -(-width // WIDTH)
    book, rng = Codebook(np.zeros((groups, CENTROIDS, WIDTH))), np.random.default_rng(0)
    for m, x in enumerate(book.split(v).swapaxes(0, 1)):
        if not len(x):
            continue
        c = x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)]
        for _ in range(ROUNDS):
            near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            n = np.bincount(near, minlength=CENTROIDS)
            sums = np.stack([np.bincount(near, x[:, w], CENTROIDS) for w in range(WIDTH)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        book.centroids[m] = c
    return book


def index(rows: DataFrame, book: Codebook) -> DataFrame:
    """``vec_id, label, v, codes, residuals``: all rows with a byte for each group and its residual norm (32-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max([1, *np.diff(batch["v"].offsets.to_numpy()).tolist()])
            codes, norms = book.encode(_matrix(batch["v"], width))
            made = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (codes, norms)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], *made], ["vec_id", "label", "v", "codes", "residuals"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, codes binary, residuals binary")


class _Block:
    """The rows of one block, in the order of their labels."""

    def __init__(self, rows: pa.Table, book: Codebook):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        groups = len(book.centroids)
        self.book, self.ids, self.labels = book, rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        take = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind).reshape(-1, groups)
        self.codes, self.norms = np.ascontiguousarray(take("codes", np.uint8).T), np.ascontiguousarray(take("residuals", np.float32).T.astype(np.float64))
        v = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
        self.v = _matrix(v, groups * WIDTH)

    def bounds(self, anchors: np.ndarray, take: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds ``[a, row]`` of the scores of the rows in ``take``."""
        tables, norms = self.book.tables(anchors)
        codes = self.codes[:, take]
        score = np.zeros((len(anchors), codes.shape[1]))
        for m in range(len(codes)):
            score += tables[:, m].take(codes[m], axis=1)
        # what floating point may lose is far below the slack
        off = norms @ self.norms[:, take] * (1 + 1e-9) + 1e-6 * np.abs(tables).max(2).sum(1)[:, None] + 0.5
        return score - off, score + off

    def exact(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Integer scores of pairs of an anchor and a row."""
        step = max(1, PAIR_CELLS // max(1, self.v.shape[1]))
        parts = [np.einsum("ij,ij->i", anchors[a[s : s + step]], self.v[r[s : s + step]]) for s in range(0, len(a), step)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def best(self, key: np.ndarray, score: np.ndarray, r: np.ndarray, most: int) -> np.ndarray:
        """The places of the first ``most`` of each key, by score and id."""
        order = np.lexsort((self.ids[r], -score, key))
        k = key[order]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        rank = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
        return order[rank < most]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; if it has fewer, minus infinity."""
    return -np.partition(-x, k - 1, axis=1)[:, k - 1] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _positives(block: _Block, anchors: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    ids, labels, v = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["v"].combine_chunks(), block.v.shape[1])
    for label in np.unique(labels).tolist():
        rows = slice(*np.searchsorted(block.labels, [label, label + 1]).tolist())
        if rows.start == rows.stop:
            continue
        mine = np.flatnonzero(labels == label)
        for s in range(0, len(mine), ANCHORS):
            at = mine[s : s + ANCHORS]
            low, high = block.bounds(v[at], rows)
            self_too = block.ids[rows] == ids[at][:, None]
            low[self_too] = high[self_too] = -np.inf
            a, r = np.nonzero((high >= _kth(low, most)[:, None]) & ~self_too)
            r = r + rows.start
            score = block.exact(v[at], a, r)
            top = block.best(a, score, r, most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at][a[top]]), pa.array(block.ids[r[top]]), pa.array(score[top])], ["anchor_id", "positive_id", "positive_score"])


def _negatives(block: _Block, anchors: pa.Table, most: int, window: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    least, greatest = window
    ids, labels, v = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["v"].combine_chunks(), block.v.shape[1])
    positives = anchors["positives"].to_pylist()
    for s in range(0, len(ids), ANCHORS):
        at = np.arange(s, min(s + ANCHORS, len(ids)))
        low, high = block.bounds(v[at], slice(0, len(block.ids)))
        same = block.labels == labels[at][:, None]
        deepest = max(len(positives[k]) for k in at)
        for p in range(deepest):
            own = [positives[k][p] if p < len(positives[k]) else None for k in at]
            goal = np.array([x["score"] if x else -1 for x in own], np.int64)[:, None]  # below 0 a window is empty
            inside = (100 * low >= least * goal) & (100 * high <= greatest * goal) & ~same
            could = (100 * high >= least * goal) & (100 * low <= greatest * goal) & ~same & (goal >= 0)
            a, r = np.nonzero(could & (high >= _kth(np.where(inside, low, -np.inf), most)[:, None]))
            score, want = block.exact(v[at], a, r), goal[a, 0]
            fits = (least * want <= 100 * score) & (100 * score <= greatest * want)
            a, r, score, want = a[fits], r[fits], score[fits], want[fits]
            top = block.best(a, score, r, most)
            a, r, score, want = a[top], r[top], score[top], want[top]
            other = np.array([x["id"] if x else 0 for x in own], np.int64)[a]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at][a], other, block.ids[r], want, score)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _streamed(book: Codebook, answer, *given):
    """Sorted by block, a block's rows come before its anchors: rows are held, anchors stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, block = None, [], None
        for batch in batches:
            blocks, kinds = batch["block"].to_numpy(), batch["is_anchor"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if x == y:
                    continue
                if blocks[x] != number:
                    number, rows, block = blocks[x], [], None
                part = pa.Table.from_batches([batch.slice(x, y - x)])
                if not kinds[x]:
                    rows.append(part)
                elif rows:
                    block = block or _Block(pa.concat_tables(rows), book)
                    yield from answer(block, part, *given)

    return run


def _blocks(indexed: DataFrame, anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of each block, then all anchors once for each block."""
    every = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("is_anchor", F.lit(True))
    rows = indexed.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id), {n_blocks}) as int)")).withColumn("is_anchor", F.lit(False))
    return rows.unionByName(every, allowMissingColumns=True).repartition(n_blocks, "block").sortWithinPartitions("block", "is_anchor", "vec_id")


def hard_negatives(rows: DataFrame, anchors, n_positives: int = 5, n_negatives: int = 5, window: tuple[int, int] = (80, 100), fit_rows: int = FIT_ROWS, block_rows: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` have ``vec_id, label, embedding``; ``anchors`` is a condition on ``vec_id``. A score is the inner product of the
    integers of :func:`integers` (within 64 bits; of vectors of different lengths the components that both have count). An anchor's positives are the first
    ``n_positives`` other rows of its label by score, then smaller id. For each, the first ``n_negatives`` rows of other labels
    whose score lies between ``window`` per cent of the positive's are returned, ranked from 1; a positive without such rows
    has none. Rows as in :func:`usable`: nulls, and components that aren't finite, take no part, repeated ids count once. Other
    columns are ignored; an empty table gives no rows. ``block_rows`` sets the size of blocks, which results don't depend on.
    """
    rows = materialize(usable(rows), "vectors")
    n = rows.count()
    book = fit(rows, fit_rows)
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    if -(-widest // WIDTH) > len(book.centroids):  # longer vectors than any of the sample
        more = np.zeros((-(-widest // WIDTH), CENTROIDS, WIDTH))
        more[: len(book.centroids)] = book.centroids
        book = Codebook(more)
    indexed = materialize(index(rows, book), "index")
    n_blocks = max(1, -(-n // (block_rows or min(max(BLOCK_ROWS[0], 32 * math.isqrt(n)), BLOCK_ROWS[1]))))
    chosen = indexed.where(anchors).select("vec_id", "label", "v")

    found = _blocks(indexed, chosen, n_blocks).mapInArrow(_streamed(book, _positives, n_positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    listed = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    chosen = materialize(chosen.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")

    kind = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _blocks(indexed, chosen, n_blocks).mapInArrow(_streamed(book, _negatives, n_negatives, window), kind)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
