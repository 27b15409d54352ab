"""Removal of lines that many documents share.

Line keys are hashed; the hashes are range-partitioned together with the document, so that one very frequent line
spreads over several partitions, and sorted by hash, document (largest first) and position. Each task streams its
partition once. It decides the runs that lie inside the partition by itself; the runs at its two ends may go on in a
neighbour, so for those it returns the lines undecided, with a count, and the counts (two a partition at most) decide
them. What comes back is positions, packed as one compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import materialize, quoted

STRIPPED = b" \t\n\x0b\x0c\r"
_LINE = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])
_SEEN = pa.schema([("kind", pa.int32()), *_LINE, ("n_docs", pa.int64())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                lines = text.split(b"\n")
                for pos, line in enumerate(lines):
                    if len(line) >= least_chars:
                        key = line.strip(STRIPPED).lower()
                        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
                            x = xxhash.xxh3_128_intdigest(key)
                            out.append((_signed(x >> 64), _signed(x & (1 << 64) - 1), doc, row, len(lines), pos))
                if len(out) > 1 << 16:
                    yield _batch(out, _LINE)
                    out = []
            yield _batch(out, _LINE)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


DROP, OPEN, COUNT = 0, 1, 2


def _stream(least_docs: int):
    """Sorted lines to dropped lines, undecided lines of the runs at the ends, and those runs' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n_docs, doc, largest, first = None, 0, None, None, True
        held: list[tuple] = []  # lines of fewer than least_docs documents, not yet decided
        out: list[tuple] = []
        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line[:2] != key:
                    if key is not None and first:  # it may have begun in the partition before
                        out.append((COUNT, *key, largest, None, None, None, n_docs))
                        first = False
                    key, n_docs, doc, largest, held = line[:2], 1, line[2], line[2], []
                elif line[2] != doc:
                    doc, n_docs = line[2], n_docs + 1
                if first:
                    out.append((OPEN, *line, None))
                elif n_docs < least_docs:
                    held.append(line)
                else:
                    out += [(DROP, *x, None) for x in [*held, line] if x[2] != largest]
                    held = []
                if len(out) > 1 << 14:
                    yield _batch(out, _SEEN)
                    out = []
        if key is not None:
            out += [(OPEN, *x, None) for x in held]
            out.append((COUNT, *key, largest, None, None, None, n_docs))
        yield _batch(out, _SEEN)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, positions in zip(batch["n_lines"].to_pylist(), batch["dropped"].to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[positions] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["n_lines"], pa.array([len(p) for p in batch["dropped"].to_pylist()], pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "row", "n_lines", "n_dropped", "keep"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the hash of their text: rows that are equal in both lose the same lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("row", F.xxhash64("text"))


def line_keep_bitmaps(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """``doc_id, row, n_lines, n_dropped, keep`` for each document that loses lines; ``row`` is the xxhash64 of its text.

    A line's key is the line stripped of U+0020 and U+0009 to U+000D, A-Z lower-cased. Keys of ``least_chars`` code
    points or more that ``least_docs`` documents or more hold lose all lines but those of the largest ``doc_id``.
    ``keep`` is a zlib-compressed bit for each line (first line: highest bit of the first byte). Rows with one
    ``doc_id`` count as one document. Rows with a null ``doc_id`` keep all lines and count nowhere; a null text is one
    empty line. An empty table gives no rows; other columns are ignored.
    """
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    lines = rows.select("doc_id", "row", "text").mapInArrow(_lines(least_chars), "hi long, lo long, doc_id long, row long, n_lines int, pos int")
    dealt = lines.repartitionByRange("hi", "lo", F.desc("doc_id")).sortWithinPartitions("hi", "lo", F.desc("doc_id"), "row", "pos")
    seen = materialize(dealt.mapInArrow(_stream(least_docs), "kind int, hi long, lo long, doc_id long, row long, n_lines int, pos int, n_docs long"), "lines")
    counts = seen.where(F.col("kind") == COUNT).groupBy("hi", "lo").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= least_docs)
    places = ["doc_id", "row", "n_lines", "pos"]
    late = seen.where(F.col("kind") == OPEN).join(F.broadcast(counts.drop("docs")), ["hi", "lo"]).where("doc_id <> largest").select(places)
    gone = seen.where(F.col("kind") == DROP).select(places).union(late)
    return gone.groupBy("doc_id", "row", "n_lines").agg(F.collect_set("pos").alias("dropped")).mapInArrow(_packed, "doc_id long, row long, n_lines int, n_dropped int, keep binary")


def _kept(with_hash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, keep in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["keep"].to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
                    text = b"\n".join(x for x, k in zip(lines, bits.tolist(), strict=True) if k)
                    n_dropped.append(len(lines) - int(bits.sum()))
                else:
                    n_dropped.append(0)
                texts.append(hashlib.sha256(text).hexdigest() if with_hash else text)
            made = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            made |= {"kept_sha256": pa.array(texts, pa.string())} if with_hash else {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([batch[c] for c in batch.schema.names if c not in ("text", "keep")] + list(made.values()), [c for c in batch.schema.names if c not in ("text", "keep")] + list(made))

    return run


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    maps = bitmaps.select(F.col("doc_id").alias("own"), F.col("row").alias("own_row"), "keep")
    return docs.join(maps, (docs["doc_id"] == maps["own"]) & (docs["row"] == maps["own_row"]), "left").drop("own", "own_row", "row")


def line_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each row under its bitmap."""
    rows = _joined(_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), bitmaps)
    return rows.select("doc_id", "text", "keep").mapInArrow(_kept(True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_shared_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """``docs`` with the shared lines gone from ``text`` and ``n_chars`` counted anew (where there is one).

    Other columns stay, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    others = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)]
    bitmaps = line_keep_bitmaps(rows, least_docs, least_chars)
    keyed = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rest", F.struct(*others, F.col("text").isNull().alias("blank"))).select("doc_id", "rest", "text"))
    joined = _joined(keyed, bitmaps).select("doc_id", "rest", "text", "keep")
    kind = joined.schema["rest"].dataType.simpleString()
    made = joined.mapInArrow(_kept(False), f"doc_id long, rest {kind}, n_lines long, n_dropped long, text string")
    text = F.when(~F.col("rest.blank"), F.col("text"))
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(rest)}
    return made.select(*[columns[c].alias(c) for c in docs.columns])
