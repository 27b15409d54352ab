"""Packing of token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's tokens are cut into full sequences and one rest. Full ones stand alone; the rests of a group are packed by
first-fit decreasing, where a tournament tree over the bins' free space finds the first bin that fits in logarithmic
time. Only lengths and checksums are shuffled, never tokens.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rests of documents that are packed together, on average.
GROUP_PIECES = 4096
#: Words whose ids a Python worker remembers at most, without the marks behind them; beyond that it keeps those at hand. Some 200 bytes each.
CACHE_WORDS = 1 << 18
#: Words that are looked at together.
WORDS_AT_ONCE = 1 << 19
#: Bytes of the texts that are split into words together; a longer text stands alone.
TEXT_BYTES = 4 << 20
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long"


_MARKS = string.punctuation
#: Ends in a letter or digit of the Latin blocks, behind which a mark begins another piece (not so behind U+0130: its small form ends in a dot above).
_PLAIN_END = r"[0-9A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"


def _letters(tokenizer) -> dict[int, str]:
    """What letters of the Latin blocks become before they come to the model, of those that stay in one piece with others."""

    def pieces(text: str) -> list[str]:
        if tokenizer.normalizer:
            text = tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    found = {}
    for c in filter(str.isalpha, map(chr, range(0x250))):
        own = pieces(c)
        if len(own) == 1 and pieces(f"a{c}a") == [f"a{own[0]}a"]:
            found[ord(c)] = own[0]
    return found


def _listed(words: pa.Array) -> list[bytes]:
    """As ``to_pylist``, which takes several times as long."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def text_slices(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of some ``most`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    s = 0
    while s < len(texts):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield texts.slice(s, e - s)
        s = e


class WordEncoder:
    """Token ids of texts through a cache by word.

    Holds for tokenizers whose pre-tokenizer drops white space and whose normalizer works character by character, so that
    the ids of a text are those of its blank-separated words, one after the other, in either case of their letters.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model, self.plain = self.tokenizer.model, _letters(self.tokenizer)
        self.letters = frozenset(map(chr, self.plain))
        self.raw = [x.tobytes() for x in np.arange(self.tokenizer.get_vocab_size(), dtype="<u4")]
        self.end = np.uint32(end).astype("<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words. The model itself is asked for words of plain letters, which are a piece each."""
        known, raw, letters, plain, tokenize, left = self.known, self.raw, self.letters, self.plain, self.model.tokenize, []
        for w in words:
            text = w.decode()
            if letters.issuperset(text):
                known[w] = b"".join([raw[t.id] for t in tokenize(text.translate(plain))])
            else:
                left.append(w)
        self._encode(left)

    def _encode(self, words: list[bytes]) -> None:
        """Encodes words as one text, which costs far less than each by itself; offsets tell whose ids are whose."""
        for s in range(0, len(words), 2048):
            part = [w.decode() for w in words[s : s + 2048]]
            begin = np.cumsum([0, *(len(w) + 1 for w in part)])
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(made.ids, "<u4").tobytes()
            at = np.array([a for a, _ in made.offsets], np.int64)
            cuts = (4 * np.searchsorted(at, begin)).tolist()
            for w, x, y in zip(words[s : s + 2048], cuts[:-1], cuts[1:], strict=True):
                self.known[w] = ids[x:y]

    def _ids(self, words: list[bytes]) -> pa.Array:
        """The ids' bytes of each word, learnt where it is new."""
        found = list(map(self.known.get, words))
        if new := [w for w, ids in zip(words, found, strict=True) if ids is None]:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
            self._learn(new)
            found = [self.known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return pa.array(found, pa.large_binary())

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The ids' bytes of each word. What stands behind a word's last letter or digit is encoded by itself, as the splitting has it."""
        stems = pc.ascii_rtrim(words, characters=_MARKS)
        cut = pc.and_(pc.not_equal(stems, words), pc.and_(pc.match_substring_regex(stems, _PLAIN_END), pc.invert(pc.match_substring(words, "<|"))))
        stems = pc.if_else(cut, stems, words)
        lengths = pc.binary_length(stems.filter(cut)).to_numpy().tolist()
        tails = pa.array([w[n:] for w, n in zip(_listed(words.filter(cut)), lengths, strict=True)], pa.binary()).dictionary_encode()
        stems = stems.dictionary_encode()
        behind = np.zeros(len(words), np.int32)
        behind[cut.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy() + 1
        ids = self._ids([*_listed(stems.dictionary), b"", *_listed(tails.dictionary)])
        return pc.binary_join_element_wise(ids.take(stems.indices), ids.take(pa.array(behind + len(stems.dictionary))), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts' ids begin, with the end of all, and the ids of all ``texts``, the end id behind each. Null texts are empty."""
        texts = pc.fill_null(texts, "")
        # letters' case only matters where it may tell a special string from plain text
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))  # one word at least, if empty
        words, stops = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        bounds, made, at = [np.zeros(1, np.int64)], [np.zeros(0, "<i4")], 0
        for s in range(0, len(words), WORDS_AT_ONCE):
            part = words.slice(s, WORDS_AT_ONCE).dictionary_encode()
            stop = stops[np.searchsorted(stops, s, "right") : np.searchsorted(stops, s + len(part), "right")] - s
            ids = pa.concat_arrays([self._of_words(part.dictionary), pa.array([self.end], pa.large_binary())])
            ids = ids.take(pa.array(np.insert(part.indices.to_numpy(), stop, len(part.dictionary))))
            ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 4
            bounds.append(at + ends[stop + np.arange(1, len(stop) + 1)])
            made.append(np.frombuffer(ids.buffers()[2], "<i4", ends[-1]))
            at += int(ends[-1])
        return np.concatenate(bounds), np.concatenate(made)

    def ids(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        bounds, ids = self.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise(bounds.tolist())]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end: int) -> WordEncoder:
    """One for each Python worker."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = WordEncoder(path, end)
    return _ENCODERS[path, end]


def _pieces(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, copies = _encoder(path, end), {}
        for batch in batches:
            rows: list[tuple] = []
            encoded = (x for texts in text_slices(batch["text"]) for x in encoder.ids(texts))
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    crc = zlib.crc32(part)
                    # equal pieces of equal documents go to different groups; which copy is which doesn't matter
                    key = xxhash.xxh3_64_intdigest(f"{doc} {start} {n} {crc}".encode())
                    if len(copies) > 1 << 20:
                        copies.clear()
                    copies[key] = turn = copies.get(key, -1) + 1
                    slot = xxhash.xxh3_64_intdigest(f"{key} {turn}".encode()) >> 1
                    rows.append((doc, start, len(part) // 4, crc, n, slot))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"])

    return run


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, longest first into the first bin with room, by a tournament tree of free space."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [size] * (2 * leaves)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[k], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[k] = (node - leaves, size - free[node])
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return out


def _packed(size: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("slot", "ascending")])
        lengths = table["length"].to_pylist()
        bins, offsets = zip(*first_fit_decreasing(lengths, size), strict=True)
        base = key[0].as_py() << 32
        table = table.drop_columns(["slot", "lot"])
        return table.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece of each row of ``docs``.

    ``tokenizer`` is a file of the tokenizers library that drops white space; each text's ids get ``end`` behind them
    and are cut every ``size`` ids. Pieces fill their sequence gaplessly from offset 0. A null or blank text has the end id
    only. Repeated rows are packed each by itself; a null ``doc_id`` is a value like another. Other columns are ignored;
    an empty table gives no rows. A group's number stands in the upper bits of ``sequence_id``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-docs.count() // group_pieces))
    pieces = docs.mapInArrow(_pieces(tokenizer, end, size), _PIECE).withColumn("lot", F.expr(f"pmod(slot, {groups}L)"))
    return pieces.groupBy("lot").applyInArrow(_packed(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
