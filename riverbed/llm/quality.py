"""Quality rules: fixed rules on counts, and a linear-chain conditional random field over a text's lines.

Each line with a word is labelled content or boilerplate by Viterbi decoding; a text is kept if enough of its words stand
in content lines. Labels of documents are given, those of their lines are hidden: training takes a line of a bad text for
boilerplate if its features are those of bad texts, and a line of a good one only if hardly a good text has them. At least half the lines of a bad text are boilerplate, and at most half of a good one's. So labels change
inside a text, and the field learns which lines follow which.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm import kernels as K
from riverbed.llm.common import labelled_sample, spread

SYMBOLS = b"#*$%&|<>"
#: Words below which a text fails, words of a repeat window, share of repeated words above which it fails (percent).
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Labelled texts that training takes at most, share of words in content lines to be kept.
SAMPLE_TEXTS, CONTENT_SHARE = 4000, 0.5
#: Share of bad texts among those with a line's features above which a line of a bad or of a good text counts as boilerplate.
DOUBT, SURE = 0.5, 0.8
#: Lines of texts that training passes at once, those that fill up shorter texts among them, or one longer text.
BATCH_LINES = 1 << 18
N_FEATURES = 14
_UPPER, _LETTER, _DIGIT = (bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(48, 58)))


def _features(line: bytes, words: list[bytes], again: bool) -> list[int]:
    """Which of the line's binary features hold."""
    size, n = len(line), len(words)
    symbols = size - len(line.translate(None, SYMBOLS))
    letters = size - len(line.translate(None, _LETTER))
    upper = size - len(line.translate(None, _UPPER))
    digits = size - len(line.translate(None, _DIGIT))
    out = [0]
    if symbols > 0.02 * size:
        out.append(1)
    if symbols > 0.1 * size:
        out.append(2)
    if upper > 0.3 * letters and letters > 1:
        out.append(3)
    if upper > 0.8 * letters and n > 2:
        out.append(4)
    if digits > 0.3 * size:
        out.append(5)
    out.append(6 if n <= 2 else 7 if n <= 7 else 8)
    if line.rstrip()[-1:] in (b".", b"!", b"?", b":", b";"):
        out.append(9)
    if line.count(b"!!") > 0.3 * n:
        out.append(10)
    if n > 4 and len(set(words)) < 0.5 * n:
        out.append(11)
    if again:
        out.append(12)
    if size > 20 * n:
        out.append(13)
    return out


@dataclass
class Field:
    """Weights of features by label (0 content, 1 boilerplate) and of label pairs."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of all sequences together: ``scores`` (line, label), ``first`` bounds of the sequences."""
        size = np.diff(first)
        labels = np.zeros(len(scores), np.int8)
        order = np.argsort(-size, kind="stable")
        order, back = order[size[order] > 0], []
        if not len(order):
            return labels
        best = scores[first[order]]
        final = np.zeros((len(order), 2))
        for t in range(1, int(size[order[0]]) + 1):
            n = int(np.searchsorted(-size[order], -t, "left"))  # sequences longer than t
            live = int(np.searchsorted(-size[order], -t, "right"))
            final[n:live] = best[n:live]
            if not n:
                break
            step = best[:n, :, None] + self.move[None]
            back.append(step.argmax(1).astype(np.int8))
            best = np.take_along_axis(step, back[-1][:, None].astype(np.int64), 1)[:, 0] + scores[first[order[:n]] + t]
        now = final.argmax(1).astype(np.int8)
        labels[first[order] + size[order] - 1] = now
        for t in range(len(back), 0, -1):
            n = len(back[t - 1])
            own = np.arange(n)
            # where the sequence goes on behind t, its label at t was set when that step was walked back
            at = first[order[:n]] + t
            labels[at - 1] = back[t - 1][own, labels[at]]
        return labels


def _expected(bits: np.ndarray, size: np.ndarray, weight: np.ndarray, scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels by set of features and expected label pairs of texts in falling length, each text by its weight.

    ``bits``: (line, text), anything behind a text's end; ``scores``: by set of features.
    """
    most, n = bits.shape
    alive = np.searchsorted(-size, -np.arange(most), "left").tolist()  # texts with more than t lines
    live = (np.arange(most)[:, None] < size)[:, :, None]
    scores = scores[bits]
    forward, backward = np.full((most, n, 2), -np.inf), np.where(live, np.zeros(2), -np.inf)
    forward[0] = scores[0]
    for t in range(1, most):
        a = alive[t]
        forward[t, :a] = np.logaddexp(forward[t - 1, :a, :1] + move[0], forward[t - 1, :a, 1:] + move[1]) + scores[t, :a]
    for t in range(most - 2, -1, -1):
        a = alive[t + 1]
        ahead = backward[t + 1, :a] + scores[t + 1, :a]
        backward[t, :a] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    total = np.logaddexp(*(forward[0] + backward[0]).T)
    found = [np.bincount(bits.ravel(), (np.exp(forward[:, :, y] + backward[:, :, y] - total) * weight).ravel(), 1 << N_FEATURES) for y in (0, 1)]
    scores += backward
    pair = [[(np.exp(forward[:-1, :, y] + move[y, z] + scores[1:, :, z] - total) * weight).sum() for z in (0, 1)] for y in (0, 1)]
    return np.stack(found, 1), np.array(pair)


def line_targets(sequences: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Labels of the lines of labelled texts (1 bad): see the head of this file."""
    mass = np.full((2, 1 << N_FEATURES), 0.5 / max(1, len(sequences)))  # a text counts once, and good ones as much as bad ones
    for y in (0, 1):
        own = [k for k in range(len(sequences)) if labels[k] == y and len(sequences[k])]
        for k in own:
            mass[y] += np.bincount(sequences[k], minlength=1 << N_FEATURES) / len(sequences[k]) / len(own)
    doubt = mass[1] / mass.sum(0)
    out = []
    for bits, bad in zip(sequences, labels, strict=True):
        d = doubt[bits]
        y, order, half = d > (DOUBT if bad else SURE), np.argsort(-d, kind="stable"), len(d) // 2
        if bad:
            y[order[: half + 1]] = True
        else:
            y[order[half:]] = False
        out.append(y.astype(np.int8))
    return out


def fit(sequences: list[np.ndarray], targets: list[np.ndarray], rounds: int = 150, decay: float = 0.002) -> Field:
    """Gradient ascent on the mean log-likelihood. ``sequences``: by text, each line's features as bits; ``targets``: the lines' labels.

    Texts of like length pass together, as many as ``BATCH_LINES`` allows.
    """
    emit, move = np.zeros((N_FEATURES, 2)), np.array([[0.5, 0.0], [0.0, 0.5]])
    some = [k for k in range(len(sequences)) if len(sequences[k])]
    if len({int(y) for k in some for y in np.unique(targets[k])}) < 2:
        emit[0, 0] = 1.0  # nothing learnt: all is content
        return Field(emit, move)
    some.sort(key=lambda k: -len(sequences[k]))
    sequences, targets = [sequences[k] for k in some], [targets[k] for k in some]
    size = np.array([len(s) for s in sequences])
    n = len(sequences)
    weight = 1.0 / size  # a text counts once, however many lines it has
    table = (np.arange(1 << N_FEATURES)[:, None] >> np.arange(N_FEATURES) & 1).astype(float)
    batches, at = [], 0
    seen, pairs = np.zeros((1 << N_FEATURES, 2)), np.zeros((2, 2))
    while at < n:
        end = min(n, at + max(1, BATCH_LINES // int(size[at])))
        bits = np.zeros((int(size[at]), end - at), np.uint16)
        for k in range(at, end):
            bits[: size[k], k - at] = sequences[k]
            for y in (0, 1):
                seen[:, y] += np.bincount(sequences[k][targets[k] == y], minlength=1 << N_FEATURES) * weight[k]
            pairs += np.bincount(2 * targets[k][:-1] + targets[k][1:], minlength=4).reshape(2, 2) * weight[k]
        batches.append((bits, size[at:end], weight[at:end]))
        at = end
    seen = table.T @ seen
    speed_e, speed_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        scores = table @ emit
        made = [_expected(*batch, scores, move) for batch in batches]
        expected, pair = table.T @ sum(e for e, _ in made), sum(p for _, p in made)
        de, dm = (seen - expected) / n - decay * emit, (pairs - pair) / n - decay * 10 * move
        speed_e, speed_m = speed_e + de**2, speed_m + dm**2
        emit, move = emit + 0.3 * de / np.sqrt(speed_e), move + 0.3 * dm / np.sqrt(speed_m)
    return Field(emit, move)


def _matrix(indices: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(indices), N_FEATURES), np.float32)
    for k, x in enumerate(indices):
        out[k, x] = 1
    return out


def _lines_of(text: bytes) -> Iterator[tuple[int, list[int], int, bool]]:
    """Number, features, words and whether it came before, of each line with a word."""
    seen: set[bytes] = set()
    for k, line in enumerate(text.split(b"\n")):
        if words := line.split():
            again = line in seen
            seen.add(line)
            yield k, _features(line, words, again), len(words), again


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.array([sum(1 << k for k in x) for _, x, _, _ in _lines_of(text)], np.uint16).tobytes() for text in batch["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(out, pa.binary())], ["label", "lines"])


def train(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Field:
    """Fits to at most ``sample_texts`` labelled documents, whole, as :func:`common.labelled_sample` takes them (1 good, 0 bad)."""
    rows = labelled_sample(docs, labels, sample_texts).mapInArrow(_sample_rows, "label int, lines binary").collect()
    rows = sorted(((1 - r["label"], r["lines"]) for r in rows if r["lines"]), key=lambda r: (zlib.crc32(r[1]), r))
    sequences = [np.frombuffer(x, np.uint16) for _, x in rows]
    return fit(sequences, line_targets(sequences, np.array([y for y, _ in rows], np.int64)))


def _repeated(words: K.Words) -> np.ndarray:
    """By row: words in windows of WINDOW words that stand twice or more in the text."""
    n_rows, n = len(words.first) - 1, len(words.start)
    if n < WINDOW:
        return np.zeros(n_rows, np.int64)
    h, row = words.hashes(), words.row()
    made = K.fold([h[k : n - WINDOW + 1 + k] for k in range(WINDOW)])
    at = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    key = K.mix(made[at] ^ K.mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:n] > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, boilerplate array<int>, kept boolean"


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        is_symbol = np.isin(np.arange(256), list(SYMBOLS))
        for batch in batches:
            data, offsets = K.buffers(batch["text"])
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            shares, listed = [], []
            for i, j in K.chunks(offsets):
                words = K.Words(data, offsets, i, j, lower=False)
                text, bounds = words.text[: words.bounds[-1]], words.bounds
                sums = lambda x, b=bounds: (s := np.concatenate([[0], np.cumsum(x)]))[b[1:]] - s[b[:-1]]
                raw = text.tobytes()
                dup, indices, sizes, numbers, first = [], [], [], [], [0]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n_dup = 0
                    for k, x, n, again in _lines_of(raw[a:b]):
                        indices.append(x)
                        sizes.append(n)
                        numbers.append(k)
                        n_dup += again
                    dup.append(n_dup)
                    first.append(len(indices))
                first = np.array(first)
                n_words = np.diff(words.first)
                for c, x in zip(cols, (n_words, sums(~K.SPACE[text] & ((text & 0xC0) != 0x80)), sums(is_symbol[text]), np.array(dup, np.int64), _repeated(words)), strict=True):
                    c.append(x.astype(np.int64))
                label = field.viterbi(_matrix(indices) @ field.emit, first)
                content = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) * (label == 0))]) if indices else np.zeros(1, np.int64)
                shares.append((content[first[1:]] - content[first[:-1]]) / np.maximum(n_words, 1))
                bad = np.concatenate([[0], np.cumsum(label == 1)])
                listed.append((np.array(numbers, np.int32)[label == 1], np.diff(bad[first])))
            made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            share = np.concatenate(shares) if shares else np.zeros(0)
            failed = (made[0] < LEAST_WORDS) | (100 * made[4] > MOST_REPEATED * made[0])
            keep = ~failed & (share >= CONTENT_SHARE)
            ends = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in listed]))]) if listed else np.zeros(1)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([x for x, _ in listed]) if listed else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, made), pa.array(failed), pa.array(share), lists, pa.array(keep)], ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))])

    return run


def quality_verdicts(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, the counts of the fixed rules, ``base_failed``, ``content_share``, ``boilerplate`` and ``kept`` for each row.

    ``boilerplate`` lists the numbers of the lines labelled so, from 0; ``content_share`` is the share of words in the others.
    Words are runs without U+0020 and U+0009 to U+000D; a null text has none and fails. Repeated rows each give a row, a
    null ``doc_id`` is a value like another, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_judged(shared), "doc_id long, " + _COLUMNS)
