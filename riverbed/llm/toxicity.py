"""Toxicity scores by a factorization machine over hashed terms.

A term is a lower-cased run of letters and digits, or the first few bytes of a longer one (its stem); terms are hashed to
slots. Of a bounded sample of labelled texts the most frequent slots are kept, and those that tell most about the label,
so that a rare insult and the common word that makes it one both stay. A machine of order two is fitted to their presence:
besides a weight each slot has a small vector, and the products of vectors weigh pairs of terms that stand in one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm import kernels as K
from riverbed.llm.common import labelled_sample, materialize

#: Slots of the hash, slots kept by frequency and as many by what they tell, texts that a kept slot occurs in at least.
SLOT_BITS, HALF_SLOTS, LEAST_TEXTS = 22, 2048, 3
#: Bytes of stems, size of a slot's vector, labelled texts that the fit takes at most.
STEMS, RANK, SAMPLE_TEXTS = (5, 6, 7, 8), 8, 20_000
#: Batches of the fit and passes over its texts at least, texts of a batch, step size, penalties of squared weights and vectors.
STEPS, EPOCHS, BATCH, RATE, PENALTY = 500, 15, 256, 0.05, (0.3, 5.0)
#: Standard deviations of a slot's toxic share that count as chance, and those beyond that make it wholly trusted; the trust
#: of a slot that all texts have.
CHANCE, SURE, COMMON = 2.0, 8.0, 0.25
#: Bytes of text handled at once, as each word gives several terms.
CHUNK_BYTES = 1 << 19
#: All bytes of ASCII that are neither letters nor digits part terms.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _slots(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Slots of the terms and their rows in the chunk, and the chunk's rows; a slot may come more than once."""
    data, offsets = K.buffers(text)
    for i, j in K.chunks(offsets, CHUNK_BYTES):
        words = K.Words(data, offsets, i, j, APART)
        row, hashes, rows = words.row(), [words.hashes()], [words.row()]
        for n in STEMS:
            at = np.flatnonzero(words.end - words.start > n)
            hashes.append(K.span_hashes(words.text, words.start[at], words.start[at] + n))
            rows.append(row[at])
        yield (np.concatenate(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate(rows), j - i


def _pairs(slots: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and the bounds of each row."""
    pair = np.unique(rows << SLOT_BITS | slots)
    return pair & ((1 << SLOT_BITS) - 1), np.searchsorted(pair >> SLOT_BITS, np.arange(n + 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and toxic texts of each slot of a task, and those of all under slot -1."""
    found, total = np.zeros((2, 1 << SLOT_BITS), np.int32), np.zeros((2, 1), np.int64)
    for batch in batches:
        labels, done = batch["label"].to_numpy(), 0
        total += [[len(labels)], [int(labels.sum())]]
        for slots, rows, n in _slots(batch["text"]):
            once, first = _pairs(slots, rows, n)
            toxic = np.repeat(labels[done : done + n], np.diff(first))
            np.add.at(found[0], once, 1)
            np.add.at(found[1], once[toxic == 1], 1)
            done += n
    at = np.flatnonzero(found[0])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), *(pa.array(np.concatenate([t, f[at].astype(np.int64)])) for t, f in zip(total, found, strict=True))], ["slot", "n", "toxic"])


def _kept_features(kept: np.ndarray):
    place = _places(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slots, rows, n in _slots(batch["text"]):
                own = place[slots] >= 0
                once, first = _pairs(slots[own], rows[own], n)
                feature = place[once].astype(np.int16)
                out += [feature[first[r] : first[r + 1]].tobytes() for r in range(n)]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(out, pa.binary())], ["label", "features"])

    return run


def _places(kept: np.ndarray) -> np.ndarray:
    """Place of each slot among the kept ones (sorted), else -1."""
    place = np.full(1 << SLOT_BITS, -1, np.int16)
    place[kept] = np.arange(len(kept))
    return place


@dataclass
class Machine:
    kept: np.ndarray  # slots, sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``features``: the distinct kept slots of the texts, by place; ``first``: bounds of the texts."""
        out = np.full(len(first) - 1, self.bias)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            v, at = self.vectors.take(features, 0), first[some]
            sums, squares = np.add.reduceat(v, at), np.add.reduceat(np.einsum("nk,nk->n", v, v), at)
            out[some] += np.add.reduceat(self.weights.take(features), at) + 0.5 * ((sums**2).sum(1) - squares)
        return out


class _Adam:
    """Steps by the means of the slopes and of their squares."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.mean, self.square, self.steps = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, slope: np.ndarray) -> None:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.square = 0.99 * self.square + 0.01 * slope**2
        self.value = self.value - self.rate * self.mean / (1 - 0.9**self.steps) / (np.sqrt(self.square / (1 - 0.99**self.steps)) + 1e-4)


def fit(labels: np.ndarray, texts: list[np.ndarray], kept: np.ndarray, trust: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss with penalties, in batches. ``texts``: the places among the ``kept`` slots that each text has.

    A slot enters with the value ``trust``, so that what says little moves little.
    """
    y, n = labels.astype(np.float64), len(labels)
    toxic = float(y.sum())
    prior = min(max((toxic + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    rng, size = np.random.default_rng(seed), len(kept)
    m = Machine(kept, float(np.log(prior / (1 - prior))), np.zeros(size), np.zeros((size, RANK)))
    if not size or toxic in (0, n):
        return m
    wide = trust[:, None]
    w, v, bias = _Adam(np.zeros(size), RATE), _Adam(rng.normal(0, 0.1, (size, RANK)), RATE), _Adam(np.array([m.bias]), RATE)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(n, BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(n)
        w.rate = v.rate = bias.rate = RATE if epoch < epochs * 2 // 3 else RATE / 4
        for s in range(0, n, BATCH):
            part = order[s : s + BATCH]
            size_of = np.array([len(texts[p]) for p in part])
            first = np.concatenate([[0], np.cumsum(size_of)])
            f = np.concatenate([texts[p] for p in part]).astype(np.int64)
            m.weights, m.vectors, m.bias = trust * w.value, wide * v.value, bias.value[0]
            error = 1 / (1 + np.exp(-np.clip(m.logits(f, first), -30, 30))) - y[part]
            dw, dv = np.zeros(size), np.zeros((size, RANK))
            if len(f):
                row, some = np.repeat(np.arange(len(part)), size_of), np.flatnonzero(size_of)
                sums = np.zeros((len(part), RANK))
                sums[some] = np.add.reduceat(m.vectors.take(f, 0), first[some])
                # slopes by slot: sort the pairs of a text and a slot by slot, add up runs
                by = np.argsort(f.astype(np.uint16), kind="stable")
                f, row = f.take(by), row.take(by)
                run = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                each = error.take(row)
                dw[f[run]] = np.add.reduceat(each, run)
                dv[f[run]] = np.add.reduceat((error[:, None] * sums).take(row, 0), run) - dw[f[run]][:, None] * m.vectors[f[run]]
            share = len(part) / n
            w.step(trust * dw + share * PENALTY[0] * w.value)
            v.step(wide * dv + share * PENALTY[1] * v.value)
            bias.step(np.array([error.sum()]))
    m.weights, m.vectors, m.bias = trust * w.value, wide * v.value, float(bias.value[0])
    return m


def trusted(n: np.ndarray, toxic: np.ndarray, texts: int, all_toxic: int) -> np.ndarray:
    """From 0 to 1: how far a slot's share of toxic texts lies from chance, or how many of all texts it is in, whichever is more."""
    share = all_toxic / texts
    z = np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share))
    return np.maximum(np.clip((z - CHANCE) / SURE, 0, 1), COMMON * np.sqrt(n / texts))


def train(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Machine:
    """Fits to at most ``sample_texts`` of the labelled documents, whole, as :func:`common.labelled_sample` takes them.

    Slots are counted by Spark; to the driver come at most ``2 * HALF_SLOTS`` of them and, by text, which of these it has
    (two bytes each). Without labels of both kinds their share is the score.
    """
    rows = labelled_sample(docs, labels, sample_texts)
    counts = rows.mapInArrow(_counts, "slot long, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "slots")
    total = counts.where("slot = -1").first()
    n, toxic = (total["n"], total["toxic"]) if total else (0, 0)
    if not 0 < toxic < n:
        return fit(np.array([1] * toxic + [0] * (n - toxic)), [], np.zeros(0, np.int64), np.zeros(0))
    counts = counts.where((F.col("slot") >= 0) & (F.col("n") >= LEAST_TEXTS))
    telling = F.abs(F.col("toxic") - F.col("n") * (toxic / n)) / F.sqrt(F.col("n"))
    found = sorted({tuple(r) for order in (F.desc("n"), telling.desc()) for r in counts.orderBy(order, "slot").limit(HALF_SLOTS).collect()})
    kept, with_it, and_toxic = np.array(found, np.int64).reshape(-1, 3).T
    texts = rows.mapInArrow(_kept_features(kept), "label int, features binary").collect()
    texts.sort(key=lambda r: (r["features"], r["label"]))  # the same machine whatever the rows' order
    return fit(np.array([r["label"] for r in texts]), [np.frombuffer(r["features"], np.int16) for r in texts], kept, trusted(with_it, and_toxic, n, toxic))


def _scores(machine: Machine, place: np.ndarray, text: pa.Array) -> pa.Array:
    out = []
    for slots, rows, n in _slots(text):
        feature = place[slots].astype(np.int64)
        own = feature >= 0
        width = max(1, len(machine.kept))
        pair = np.unique(rows[own] * width + feature[own])
        logit = machine.logits(pair % width, np.searchsorted(pair // width, np.arange(n + 1)))
        out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())


def _score_column(docs: DataFrame, machine: Machine):
    """Only texts go to Python and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast((machine, _places(machine.kept)))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return _scores(*shared.value, text)

    return score(F.col("text").cast("string"))


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of each row: 0 to 1, higher for likelier toxic. A null or blank text has the score of no term.

    Repeated rows each give a row, a null ``doc_id`` is a value like another, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _score_column(docs, machine).alias("score"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    return docs.where(_score_column(docs, machine) < threshold)
