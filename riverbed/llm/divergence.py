"""How the sources of a language differ in their use of terms: a sort-based, streaming audit.

Tasks first bring the terms of their own documents into the order (lang, term, source, document) and scan the runs, so that
one row for each run of a task is shuffled, however often a term occurs. Those rows are repartitioned by (lang, term) and
sorted by (lang, term, source, document); a second run-length scan gives each term's documents and counts and lets the
frequent ones through. A last scan takes one row for each kept term, with the shares of all sources, and adds up the
distances of all pairs of sources inside the task: it emits partial pairs, never the pairs of one term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm import kernels as K
from riverbed.llm.common import materialize, spread

#: ASCII bytes that part terms: all but letters. Other characters belong to terms.
APART = np.array([b < 128 and not (65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
#: Bytes of text handled at once, and runs that a task holds before it passes them on.
CHUNK_BYTES, HELD_RUNS = 4 << 20, 1 << 20
#: Cells of pair sums that a task holds before it passes them on.
HELD_CELLS = 1 << 22
#: Shares are in units of one to this many.
UNIT = 1_000_000_000
_RUN = "lang string, term string, source string, doc_id long, n_docs long, n long"
_RUN_NAMES = ["lang", "term", "source", "doc_id", "n_docs", "n"]


def _steps(*columns: np.ndarray) -> np.ndarray:
    """The places at which a run of rows that are equal in all columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _TaskRuns:
    """Runs of one task: (group, term) with documents, counts and the smallest document."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, group: np.ndarray, doc: np.ndarray) -> None:
        words = K.Words(data, offsets, i, j, APART)
        if not len(words.start):
            return
        by = np.argsort(group, kind="stable")  # documents of one group are neighbours
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        found = pa.array(words.hashes()).dictionary_encode()
        code, hashes = found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()
        first = np.empty(len(hashes), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        new = np.flatnonzero([h not in self.terms for h in hashes.tolist()])
        self.terms.update(zip(hashes[new].tolist(), K.strings(words.text, words.start[first[new]], words.end[first[new]]), strict=True))
        key = np.sort(code * len(by) + rank[words.row()])  # by term, group, document
        at = _steps(key)
        count = np.diff(np.append(at, len(key)))
        term, row = np.divmod(key[at], len(by))
        row = by[row]
        at = _steps(term, group[row])
        self._hold(group[row[at]], hashes[term[at]], np.diff(np.append(at, len(term))), np.add.reduceat(count, at), np.minimum.reduceat(doc[row], at))

    def _hold(self, *run: np.ndarray) -> None:
        self.parts.append(run)
        self.held += len(run[0])
        if self.held > HELD_RUNS:
            self._merge()

    def _merge(self) -> None:
        group, term, n_docs, n, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((group, term))
        group, term = group[order], term[order]
        at = _steps(term, group)
        add = lambda x, f=np.add: f.reduceat(x[order], at)
        self.parts = [(group[at], term[at], add(n_docs), add(n), add(doc, np.minimum))]
        self.held = len(at)

    def runs(self) -> Iterator[pa.RecordBatch]:
        """All runs; none is held any more."""
        if self.parts:
            self._merge()
            names = list(self.groups)
            lang, source = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
            for s in range(0, self.held, 1 << 16):
                group, term, n_docs, n, doc = (x[s : s + (1 << 16)] for x in self.parts[0])
                texts = pa.array([self.terms[h] for h in term.tolist()], pa.binary()).cast(pa.string())
                group = pa.array(group)
                yield pa.RecordBatch.from_arrays([lang.take(group), texts, source.take(group), *map(K.long_column, (doc, n_docs, n))], _RUN_NAMES)
        self.__init__()


def _task_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _TaskRuns()
    for batch in batches:
        pairs = zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)
        group = np.array([held.groups.setdefault(p, len(held.groups)) for p in pairs], np.int64)
        doc = batch["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        data, offsets = K.buffers(batch["text"])
        for i, j in K.chunks(offsets, CHUNK_BYTES):
            held.add(data, offsets, i, j, group[i:j], doc[i:j])
            if held.held > HELD_RUNS // 2:
                held._merge()
                if held.held > HELD_RUNS // 2:  # too many different runs
                    names = held.groups
                    yield from held.runs()
                    held.groups = names
    yield from held.runs()


def _frequent(least_docs: int):
    """Sorted runs to one row for each source of each term that enough documents have; ``first`` marks a term's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows = None  # summed rows of the last term so far: it may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_rows is None else pa.concat_tables([open_rows, table])
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            differs = lambda c, t=table: pc.not_equal(t[c][1:], t[c][:-1]).to_numpy()
            new_term = differs("lang") | differs("term")
            at = np.flatnonzero(np.append(True, new_term | differs("source")))
            total = {c: np.add.reduceat(table[c].to_numpy(), at) for c in ("n_docs", "n")} | {"doc_id": np.minimum.reduceat(table["doc_id"].to_numpy(), at)}
            summed = table.select(["lang", "term", "source"]).take(pa.array(at))
            for c in ("doc_id", "n_docs", "n"):
                summed = summed.append_column(c, pa.array(total[c], pa.int64()))
            begins = np.append(0, np.searchsorted(at, np.flatnonzero(new_term) + 1))
            yield from _kept(summed.slice(0, begins[-1]), begins[:-1], least_docs)
            open_rows = summed.slice(begins[-1])
        if open_rows is not None:
            yield from _kept(open_rows, np.zeros(1, np.int64), least_docs)

    return run


def _kept(rows: pa.Table, begins: np.ndarray, least_docs: int) -> Iterator[pa.RecordBatch]:
    if rows.num_rows:
        size = np.diff(np.append(begins, rows.num_rows))
        docs = np.add.reduceat(rows["n_docs"].to_numpy(), begins)
        first = np.zeros(rows.num_rows, np.int64)
        first[begins] = 1
        rows = rows.append_column("first", pa.array(first)).filter(pa.array(np.repeat(docs >= least_docs, size)))
        yield from rows.combine_chunks().to_batches()


def frequent_terms(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """``lang, term, source, doc_id, n_docs, n, first``: documents and occurrences of each term that ``least_docs`` documents have.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Each row of ``docs`` is a document, also where
    ids repeat; null texts, languages and sources are empty. ``least_docs`` holds for a language, all sources together.
    ``doc_id`` is the smallest id of the source's documents that have the term (null: they have none), ``first`` is 1 in one
    row of each term and 0 in its others.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    runs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text)).mapInArrow(_task_runs, _RUN)
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "doc_id")
    kept = dealt.mapInArrow(_frequent(least_docs), f"{_RUN}, first long")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") < np.iinfo(np.int64).max, F.col("doc_id")))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of terms to sums of distances, for each language and pair of sources."""
    sums: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, cells in sums.items():
            i, j = np.nonzero(~np.eye(len(cells), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cells[i, j], pa.int64())], ["lang", "i", "j", "f"])
        sums.clear()

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lang in set(langs):
            shares = batch["shares"].filter(pa.array([x == lang for x in langs]))
            shares = shares.flatten().to_numpy().reshape(len(shares), -1)
            cells = sums.setdefault(lang, np.zeros((shares.shape[1],) * 2, np.int64))
            for s in range(0, len(shares), 1024):
                part = shares[s : s + 1024]
                for i in range(part.shape[1]):
                    cells[i] += np.abs(part - part[:, i : i + 1]).sum(0)
            if sum(c.size for c in sums.values()) > HELD_CELLS:
                yield from out()
    yield from out()


def _share(count, total, kept_terms):
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)), exact: the product has up to 28 digits."""
    whole = lambda x: x.cast("decimal(19,0)")
    parts = F.struct((whole(F.lit(UNIT)) * whole(count + 5)).alias("a"), (total + 5 * kept_terms).cast("decimal(20,0)").alias("b"))
    return F.call_function("div", parts["a"], parts["b"]) + 1


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) that occurs.

    A share is ``1 + floor(UNIT * (count + 5) / (N + 5 * V))``: V terms that ``least_docs`` documents of the language have,
    N their occurrences in the source or, for a language's own share, in all its sources. Part ``pair`` ranks a language's
    other sources by the sum of differences of shares over all V terms (0 if there are none). Part ``term`` ranks the terms
    that occur in the source and whose share is above the language's, by the difference, up to ``most_terms``. Equal values
    rank by the item's UTF-8 bytes. Documents as in :func:`frequent_terms`; an empty table gives no rows.
    """
    kept = materialize(frequent_terms(docs, least_docs), "terms")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum("first").alias("v"))
    groups = docs.select(names).distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    # one row for each language: as many entries as each of its sources has rows in the result
    groups = materialize(groups.groupBy("lang").agg(F.max("v").alias("v"), F.sort_array(F.collect_list("s")).alias("s")), "sources")
    listed = kept.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("of"), F.sum("n").alias("all_n"))
    dense = listed.join(groups, "lang").withColumn("shares", F.transform("s", lambda s: _share(F.coalesce(F.col("of")[s["source"]], F.lit(0)), s["n"], F.col("v"))))
    dense = materialize(dense.select("lang", "term", "of", "all_n", "shares"), "shares")

    sums = dense.select("lang", "shares").mapInArrow(_pair_sums, "lang string, i int, j int, f long").groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    first = groups.select("lang", F.posexplode("s").alias("i", "a"), "s")
    pairs = first.select("lang", "i", F.col("a.source").alias("source"), F.posexplode("s").alias("j", "b")).where("i <> j")
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.coalesce("f", F.lit(0)).alias("value"))

    all_n = F.aggregate("s", F.lit(0).cast("long"), lambda x, s: x + s["n"])
    own = dense.join(groups, "lang").withColumn("q", _share(F.col("all_n"), all_n, F.col("v")))
    own = own.select("lang", "term", "of", "q", F.posexplode(F.arrays_zip(F.col("s.source").alias("source"), "shares")).alias("k", "x"))
    own = own.where((F.col("of")[F.col("x.source")] > 0) & (F.col("x.shares") > F.col("q")))
    own = own.select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.shares") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(own).where(F.col("rank") <= most_terms))
