"""N-gram Jaccard self-join by rare-first prefix filtering.

Texts with the same shingle set form one entity, so copies meet once. A pass over the texts counts shingles in a sketch
of fixed size; it fixes the order from rare to frequent in which a set's prefix is taken. Only prefix shingles are
shuffled. Entities that share one are compared under the length, positional and suffix filters, and what passes is
verified once, on the whole sets.

Groups of near copies don't become all their pairs: first every entity meets one partner, which its posting lists,
sorted by position, name most often as the one before it or the first one. What these links leave in different
components of one list meets again, where the filters run inside the task and only the pairs that pass leave it: in a
second round each entity's most similar partner of another component, in a third one all pairs that are still apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm import kernels as K
from riverbed.llm.common import materialize
from riverbed.llm.components import connected_components

#: Bits of a Bloom filter, as bits of their index: the least, and the most (32 MB); bits for each key.
BLOOM_BITS, MOST_BLOOM_BITS, KEY_BITS = 23, 28, 16
#: Cells of a set's suffix signature; slices of a sketch; tasks' slices that are put together in a first step, in one task.
CELLS, SLICES, FIRST_STEP = 64, 64, 64
#: Counters of the frequency sketch, in bits: the least and the most (64 MB); rows of ``docs`` for which the least will do.
LEAST_BITS, MOST_BITS, BITS_ROWS = 20, 24, 1 << 18
#: Tasks that read the keys of a Bloom filter at most.
BLOOM_TASKS = 256
#: Texts with one shingle beyond which its posting list is dealt out to several tasks.
HOT_TEXTS = 1 << 15
#: Widths of the bitmaps of sets (eight bits a shingle; larger sets have none); rows of a list that meet in one task.
BITMAP_WIDTHS, LIST_ROWS = (512, 1024, 2048, 4096), 4096
_SEED = np.uint64(0x5851F42D4C957F2D)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    data, offsets = K.buffers(batch["text"])
    for i, j in K.chunks(offsets):
        hashes, first = K.shingles(K.Words(data, offsets, i, j), n)
        at = first.tolist()
        for r in range(j - i):
            h = np.sort(hashes[at[r] : at[r + 1]])
            yield i + r, h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h


def _prints(h: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set, as two signed longs."""
    if not len(h):
        return 0, 0
    both = np.array([np.add.reduce(K.mix(h + _SEED)), np.bitwise_xor.reduce(K.mix(h ^ _SEED))])
    hi, lo = K.mix(both + np.uint64(len(h))).view(np.int64).tolist()
    return hi, lo


def _bitmap(h: np.ndarray) -> bytes | None:
    width = next((w for w in BITMAP_WIDTHS if w >= 8 * len(h)), 0)
    if not width or not len(h):
        return None
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _digest(n: int, bits: int) -> Callable:
    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), []
            for r, h in _sets(batch, n):
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
                cells = np.minimum(np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255) if len(h) else np.zeros(0)
                rows.append((ids[r], *_prints(h), len(h), cells.astype(np.uint8).tobytes(), _bitmap(h), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], _NAMES)
        if counts.any():
            parts = [x.tobytes() for x in counts.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*[[None] * SLICES] * 6, list(range(SLICES)), parts), _TYPES, strict=True)], _NAMES)

    return run


_NAMES = ["doc_id", "hi", "lo", "n", "cells", "bitmap", "slice", "counts"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]


def _put_together(kind: str, put) -> Callable:
    """Slices of several tasks to one of each number, by ``put``."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x = np.frombuffer(x, kind)
                sums[k] = put(sums[k], x) if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    return run


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.int64) + y, 2**31 - 1).astype(np.int32)


def _gather(df: DataFrame, tasks: int, put) -> dict[int, np.ndarray]:
    """A sketch's slices (a fixed number of fixed size) on the driver.

    ``df`` has those of each of ``tasks`` tasks. Each slice is put together by a task of its own, first in several parts if
    there are many, so that no task reads more than some :data:`FIRST_STEP` of them.
    """
    run, kind = _put_together("<i4", put), "slice int, counts binary"
    for _ in range(4):
        if tasks <= FIRST_STEP:
            break
        parts = -(-tasks // FIRST_STEP)
        df = df.withColumn("part", F.expr(f"pmod(monotonically_increasing_id() div {SLICES} + spark_partition_id(), {parts})"))
        df, tasks = df.repartition(parts * SLICES, "slice", "part").select("slice", "counts").mapInArrow(run, kind), parts
    return {r["slice"]: np.frombuffer(r["counts"], np.int32) for r in df.repartition(SLICES, "slice").mapInArrow(run, kind).collect()}


def _whole(rows: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Slices as one array of ``size``; those that aren't there are zero."""
    out = np.zeros((SLICES, size // SLICES), np.int32)
    for k, x in rows.items():
        out[k] = x
    return out.ravel()


def _prefixes(n: int, num: int, den: int, counts, bits: int) -> Callable:
    """Shingles of prefixes with their entity. A hot shingle's entities are dealt to as many ``lot``s as its frequency asks for."""

    def run(batches):
        frequency, seen = counts.value, set()
        # what a counter has by chance, as several shingles share it: lots go by what is above that
        shared = int(frequency.mean(dtype=np.float64) + 6 * frequency.mean(dtype=np.float64) ** 0.5)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for _, h in _sets(batch, n):
                if not len(h) or (key := _prints(h)) in seen:
                    continue
                if len(seen) > 1 << 17:
                    seen.clear()
                seen.add(key)
                size = len(h) - -(-num * len(h) // den) + 1
                order = frequency[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                rank = (order << np.uint64(32)) | (h >> np.uint64(12) & np.uint64(0xFFFFFFFF))
                if size < len(h):
                    best = np.argpartition(rank, size - 1)
                    edge = rank[best[size - 1]]
                    best = np.flatnonzero(rank <= edge)
                else:
                    best = np.arange(len(h))
                best = best[np.lexsort((h[best], rank[best]))][:size]
                lots = np.maximum(order[best].astype(np.int64) - shared, 0) // HOT_TEXTS
                lot = np.where(lots > 0, 1 + (key[1] & 0x7FFFFFFF) % (lots + 1), 0).astype(np.int32)  # 0: not a hot one
                for x, y in zip(out, (h[best], np.full(size, key[1], np.int64), np.full(size, len(h), np.int32), np.arange(size, dtype=np.int32), lot), strict=True):
                    x.append(y)
            if out[0]:
                h, e, size, at, lot = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([K.long_column(h), pa.array(e), pa.array(size), pa.array(at), pa.array(lot)], ["h", "e", "n", "pos", "lot"])

    return run


def _bloom_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = K.mix(keys.view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in (0, 11, 22, 33)]


def _bloom(size: int) -> Callable:
    """Bits of a task's keys, as slices."""

    def run(batches):
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            for x in _bloom_bits(batch["e"].to_numpy(), size):
                bits[x] = True
        packed = np.packbits(bits).view(np.int32).reshape(SLICES, -1)
        full = [k for k in range(SLICES) if packed[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed[k].tobytes() for k in full], pa.binary())], ["slice", "counts"])

    return run


def _wanted_sets(n: int, bits, size: int) -> Callable:
    def run(batches):
        bloom, seen = bits.value, set()
        for batch in batches:
            rows: list[tuple] = []
            for _, h in _sets(batch, n):
                if not len(h) or (key := _prints(h)) in seen:
                    continue
                if all(bloom[x[0] >> 3] >> (7 - (x[0] & 7)) & 1 for x in _bloom_bits(np.array([key[1]], np.int64), size)):
                    if len(seen) > 1 << 17:
                        seen.clear()
                    seen.add(key)
                    rows.append((*key, h.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["hi", "e", "words"])

    return run


def _verified(num: int, den: int) -> Callable:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["words"].to_pylist(), batch["other"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["hi_a", "a", "hi_b", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sure(a: dict, num: int, den: int):
    """Length and positional filter as a column: ``n``/``pos`` against the columns named in ``a``."""
    n, pos, m, at = F.col("n"), F.col("pos"), F.col(a["n"]), F.col(a["pos"])
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((1 + F.least(n - pos, m - at) - 1) * (den + num) >= num * (n + m))


def _most_common(cx: np.ndarray, cy: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection from the sets' cell counts (suffix filter); a full cell bounds nothing."""
    return np.where((cx == 255) | (cy == 255), np.maximum(n, m)[:, None], np.minimum(cx, cy)).sum(1)


def _suffix(num: int, den: int) -> Callable:
    def run(batches):
        for batch in batches:
            cx, cy = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in ("cells", "other"))
            n, m = (batch[c].to_numpy().astype(np.int64) for c in "nm")
            keep = _most_common(cx, cy, n, m) * (den + num) >= num * (n + m)
            yield batch.select(["e", "f", "k"]).filter(pa.array(keep))

    return run


class _Signatures:
    """Cell counts and bitmaps of a run's entities, which bound how much two sets can have in common."""

    def __init__(self, n: np.ndarray, cells: list[bytes], bitmaps: list[bytes | None]):
        self.n = n
        self.cells = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELLS).astype(np.int64)
        self.width = np.array([0 if x is None else 8 * len(x) for x in bitmaps])
        self.words, wider = {}, None
        for width in sorted(BITMAP_WIDTHS, reverse=True):
            made = np.zeros((len(n), width // 64), np.uint64)
            own = np.flatnonzero(self.width == width)
            if len(own):
                made[own] = np.frombuffer(b"".join(bitmaps[k] for k in own), np.uint64).reshape(len(own), -1)
            if wider is not None:  # a wider bitmap folds by its halves
                made |= wider[:, : width // 64] | wider[:, width // 64 :]
            self.words[width] = wider = made

    def bounds(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the intersections of entities ``p`` and ``q``.

        A bit that only one set has stands for at least one shingle that the other one lacks.
        """
        n, m = self.n[p], self.n[q]
        most, width = _most_common(self.cells[p], self.cells[q], n, m), np.minimum(self.width[p], self.width[q])
        for w, words in self.words.items():
            at = np.flatnonzero(width == w)
            if len(at):
                x, y = words[p[at]], words[q[at]]
                only_x, only_y = np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                most[at] = np.minimum(most[at], np.minimum(n[at] - only_x, m[at] - only_y))
        return most


def _across(num: int, den: int, best: bool) -> Callable:
    """Pairs of one posting list in different components that pass the length, positional and suffix filters.

    Rows come sorted by list part (``h``); a part is compared block against block, so memory is bounded by the block. With
    ``best`` only the partner that may be most similar is returned for each row, as ``e, f, score``.
    """
    block = 256

    def pairs(part, of: _Signatures, base: int):
        n, pos, comp, blk, diagonal = part
        for i in range(0, len(n), block):
            for j in range(i, len(n), block):
                a, b = slice(i, i + block), slice(j, j + block)
                low, high = np.minimum.outer(n[a], n[b]), np.maximum.outer(n[a], n[b])
                ok = (comp[a][:, None] != comp[b][None]) & (den * low >= num * high)
                ok &= diagonal[a][:, None] | (blk[a][:, None] != blk[b][None])
                need = num * np.add.outer(n[a], n[b])
                ok &= np.minimum.outer(n[a] - pos[a], n[b] - pos[b]) * (den + num) >= need
                if i == j:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                for s in range(0, len(x), 1 << 14):
                    p, q = x[s : s + (1 << 14)] + i, y[s : s + (1 << 14)] + j
                    most = of.bounds(p + base, q + base)
                    good = most * (den + num) >= num * (n[p] + n[q])
                    yield p[good] + base, q[good] + base, (most / np.maximum(n[p] + n[q] - most, 1))[good]

    def closed(table: pa.Table, cut: int):
        h = table["h"].to_numpy()[:cut]
        at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [cut]])
        e, *cols = (table[c].to_numpy()[:cut] for c in ("e", "n", "pos", "comp", "blk", "diagonal"))
        of = _Signatures(cols[0], table["cells"].slice(0, cut).to_pylist(), table["bitmap"].slice(0, cut).to_pylist())
        found: set[tuple[int, int]] = set()
        top, partner = np.full(cut, -1.0), np.full(cut, -1)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i > 1:
                for p, q, score in pairs([c[i:j] for c in cols], of, i):
                    if best:
                        for x, y in ((p, q), (q, p)):
                            order = np.lexsort((e[y], score))
                            last = dict(zip(x[order].tolist(), order.tolist(), strict=True))
                            rows, k = np.array(list(last), np.int64), np.array(list(last.values()), np.int64)
                            better = score[k] > top[rows] if len(rows) else np.zeros(0, bool)
                            top[rows[better]], partner[rows[better]] = score[k[better]], y[k[better]]
                    else:
                        x, y = e[p], e[q]
                        found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
        if best:
            have = np.flatnonzero(partner >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(e[have]), pa.array(e[partner[have]]), pa.array(top[have])], ["e", "f", "score"])
        elif found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 1 << 14:
                    table = pa.Table.from_batches(held)
                    h = table["h"].to_numpy()
                    if cut := int(np.searchsorted(h, h[-1])):
                        yield from closed(table, cut)
                        held[:] = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from closed(table, table.num_rows)

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.bits = min(MOST_BITS, LEAST_BITS + max(0, int(np.ceil(np.log2(max(1, docs.count()) / BITS_ROWS)))))
        made = materialize(self.docs.mapInArrow(_digest(n, self.bits), "doc_id long, hi long, lo long, n long, cells binary, bitmap binary, slice int, counts binary"), "digest")
        self.digest = made.where("slice is null").select("doc_id", "hi", "lo", "n")
        slices = made.where("slice is not null").select("slice", "counts")
        self.counts = self.spark.sparkContext.broadcast(_whole(_gather(slices, -(-slices.count() // SLICES), _plus), 1 << self.bits))
        self.signatures = made.where("slice is null").groupBy(F.col("lo").alias("e")).agg(F.max("cells").alias("cells"), F.max("bitmap").alias("bitmap"))
        self.cells = self.signatures.select("e", "cells")
        #: Entities and their smallest document.
        self.entities = self.digest.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))

    def lists(self) -> DataFrame:
        """Posting lists, each entity once in a list; entities without another one of a fitting length in the list are left out.

        Lists of hot shingles stay whole, as their lots don't see each other.
        """
        rows = self.docs.select("text").mapInArrow(_prefixes(self.n, self.num, self.den, self.counts, self.bits), "h long, e long, n int, pos int, lot int").repartition("h", "lot")
        once = rows.groupBy("h", "lot", "e").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
        w, n = Window.partitionBy("h", "lot").orderBy("n"), F.col("n").cast("long")
        fits = (self.den * F.lag(n).over(w) >= self.num * n) | (self.den * n >= self.num * F.lead(n).over(w)) | (F.col("lot") > 0)
        return materialize(once.withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits").drop("fits"), "lists")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a < b`` of entities (each once) that link, as edges between their smallest documents."""
        size = min(MOST_BLOOM_BITS, max(BLOOM_BITS, int(np.ceil(np.log2(max(1, 2 * pairs.count()) * KEY_BITS)))))
        # few tasks, each with many keys: every one of them has a filter of its own
        ends = pairs.select(F.explode(F.array("a", "b")).alias("e")).coalesce(BLOOM_TASKS)
        bloom = _whole(_gather(ends.mapInArrow(_bloom(size), "slice int, counts binary"), ends.rdd.getNumPartitions(), np.bitwise_or), (1 << size) // 32)
        shared = self.spark.sparkContext.broadcast(bloom.view(np.uint8))
        sets = materialize(self.docs.select("text").mapInArrow(_wanted_sets(self.n, shared, size), "hi long, e long, words binary").dropDuplicates(["hi", "e"]), "sets")
        left = sets.select(F.col("hi").alias("hi_a"), F.col("e").alias("a"), "words")
        right = sets.select(F.col("hi").alias("hi_b"), F.col("e").alias("b"), F.col("words").alias("other"))
        good = pairs.join(left, "a").join(right, "b").select("hi_a", "a", "hi_b", "b", "words", "other").mapInArrow(_verified(self.num, self.den), "hi_a long, a long, hi_b long, b long")
        one, two = (self.entities.select(F.col("hi").alias(f"hi_{x}"), F.col("lo").alias(x), F.col("node").alias(f"node_{x}")) for x in "ab")
        return materialize(good.join(one, ["hi_a", "a"]).join(two, ["hi_b", "b"]).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).where("a is not null and b is not null"), "edges")

    def near(self, lists: DataFrame) -> DataFrame:
        """For each entity the partner that it most often meets as the one before it or the first one of a list.

        At most one pair an entity, after the length, positional and suffix filters. Dense groups so link to few centres.
        """
        w = Window.partitionBy("h", "lot").orderBy("pos", "n", "e")
        before = F.lag(F.struct("e", "n", "pos")).over(w)
        first = F.first(F.struct("e", "n", "pos")).over(w)
        rows = lists.select("e", "n", "pos", "h", "lot", F.array_distinct(F.array(before, first)).alias("o"))
        # the lots of a hot list meet through its first entity of all
        hot = lists.where("lot > 0")
        heads = hot.groupBy("h").agg(F.min(F.struct("pos", "n", "e")).alias("f")).select("h", F.array(F.struct("f.e", "f.n", "f.pos")).alias("o"))
        rows = rows.select("e", "n", "pos", "o").unionByName(hot.join(heads, "h").select("e", "n", "pos", "o")).select("e", "n", "pos", F.filter("o", lambda x: x.isNotNull()).alias("o"))
        rows = rows.select("e", "n", "pos", F.explode("o").alias("o")).select("e", "n", "pos", F.col("o.e").alias("f"), F.col("o.n").alias("m"), F.col("o.pos").alias("at"))
        met = rows.where("e <> f").where(_sure({"n": "m", "pos": "at"}, self.num, self.den)).groupBy("e", "f", "n", "m").agg(F.count("*").alias("k"))
        met = met.join(self.cells, "e").join(self.cells.select(F.col("e").alias("f"), F.col("cells").alias("other")), "f")
        good = met.select("e", "f", "n", "m", "k", "cells", "other").mapInArrow(_suffix(self.num, self.den), "e long, f long, k long")
        best = good.groupBy("e").agg(F.max_by("f", F.struct("k", "f")).alias("f"))
        return best.select(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).distinct()

    def rest(self, lists: DataFrame, components: DataFrame, best: bool) -> DataFrame:
        """In each list, the filtered pairs that the links so far leave in different components; with ``best`` one an entity.

        A long list is dealt out by pairs of parts, so that no task gets more than two parts at once.
        """
        of = self.entities.join(components, "node", "left").groupBy(F.col("lo").alias("e")).agg(F.min(F.coalesce("component", "node")).alias("comp"))
        rows = lists.join(of, "e")
        size = rows.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / LIST_ROWS).alias("parts")).where("low <> high").select("h", "parts")
        rows = rows.join(size, "h")
        rows = rows.withColumn("blk", F.expr("pmod(xxhash64(e), parts)")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        part = F.xxhash64("h", F.least("blk", "t"), F.greatest("blk", "t"))
        rows = rows.join(self.signatures, "e").select(part.alias("h"), "e", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "comp", "blk", (F.col("blk") == F.col("t")).alias("diagonal"), "cells", "bitmap")
        dealt = rows.repartition("h").sortWithinPartitions("h", "pos", "e")
        if not best:
            return dealt.mapInArrow(_across(self.num, self.den, False), "a long, b long").distinct()
        met = dealt.mapInArrow(_across(self.num, self.den, True), "e long, f long, score double").groupBy("e").agg(F.max_by("f", F.struct("score", "f")).alias("f"))
        return met.select(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).distinct()

    def run(self) -> DataFrame:
        lists = self.lists()
        components = connected_components(self.verify(materialize(self.near(lists), "pairs")))
        for best in (True, False):
            more = materialize(self.rest(lists, components, best), "pairs")
            edges = None if more.isEmpty() else self.verify(more)
            if edges is not None and not edges.isEmpty():
                components = connected_components(components.select(F.col("component").alias("a"), F.col("node").alias("b")).union(edges))
        ids = self.entities.join(components, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component_id"))
        out = self.digest.join(ids, ["hi", "lo"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A text's set holds its distinct ``n``-word shingles; with fewer words, the whole sequence as one. Two texts link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest ``doc_id`` that links reach, itself
    included. A null or blank text has an empty set and links with nothing. Rows with the same ``doc_id`` count as one
    document's; each gives a row. A null ``doc_id`` takes part only by an equal set. An empty table gives no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    return _Join(docs, n, percent, 100).run()
