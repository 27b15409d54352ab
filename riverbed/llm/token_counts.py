"""Exact token counts of every prefix of a text, by dynamic programming over the merges of a byte-level BPE.

A text is first split as the tokenizer's pre-tokenizer splits it; pieces are encoded independently. Within a piece, the
encoding of a prefix ends with exactly one token, the one that may stand behind the encoding of what comes before it:
``count[i] = count[i - len(token)] + 1``. Two tokens may stand side by side if encoding their joined bytes gives them
back. One pass over a piece so gives the counts of all its prefixes; truncation and budgets read them off.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import spread

#: White space as the pre-tokenizer's pattern means it (Unicode's White_Space).
_WS = "\t-\r \x85\xa0  -     　"
#: Splits a text where no piece can go across.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_RUN = re.compile(f"[{_WS}]{{2,}}")
#: Prefixes and pairs of tokens (and half as many chunks) that a task remembers; beyond that it forgets and starts again.
CACHE = 1 << 20
#: Chunks of more letters and pieces of more bytes are not remembered, so that memory is bounded by a multiple of the longest text.
SHORT = 64


#: What made a single byte: no merge.
_BYTE = (-1, b"", b"")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte: its own where that is printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.tokens = {as_bytes(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        #: Rank and parts of the merge that makes a token.
        self.made = {}
        for (a, b), k in self.ranks.items():
            self.made.setdefault(a + b, (k, a, b))
        self.longest = max(map(len, self.tokens))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        # the pattern that splits pieces in a byte-level pre-tokenizer
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.state: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.steps: dict[str, bytes] = {}
        self.runs: dict[str, np.ndarray] = {}

    def _whole(self, token: bytes) -> bool:
        """Whether the merges make a token of its own bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            ranks = [self.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                return False
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def _side_by_side(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a's and b's joined bytes is these two tokens (of b's bytes, if a is empty: that one).

        The last merge in either is undone, then the last before that, and so on: what then stands at the border must not
        have been merged earlier. Of equal merges the one further left comes first.
        """
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            found = self._whole(b) if not a else self._side_by_side(b"", b) and self._stay_apart(a, b)
            self.fits[a, b] = found
        return found

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        ranks, made, limit = self.ranks, self.made, 1 << 60
        while True:
            if ranks.get((a, b), 1 << 60) < limit:
                return False
            (x, _, inner), (y, first, _) = made.get(a, _BYTE), made.get(b, _BYTE)
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, inner
            else:
                limit, b = y + 1, first

    def _state(self, piece: bytes) -> tuple[int, bytes, bytes]:
        """Count, last token and the count's steps from byte to byte of a short piece; its prefixes' are remembered, too."""
        state, tokens, fits = self.state, self.tokens, self.fits
        found = state.get(piece)
        if found is not None:
            return found
        if len(state) > CACHE:
            state.clear()
        state[b""] = (0, b"", b"")
        known = len(piece) - 1
        while piece[:known] not in state:
            known -= 1
        before, _, steps = state[piece[:known]]
        for i in range(known + 1, len(piece) + 1):
            for j in range(max(0, i - self.longest), i):  # exactly one token fits; in a short piece it is a long one
                t = piece[j:i]
                if t in tokens:
                    n, last, _ = state[piece[:j]]
                    ok = fits.get((last, t))
                    if self._side_by_side(last, t) if ok is None else ok:
                        steps += bytes(((n + 1 - before) & 255,))
                        before = n + 1
                        state[piece[:i]] = (before, t, steps)
                        break
        return state[piece]

    def _long_counts(self, piece: bytes) -> np.ndarray:
        """Counts of a piece's prefixes by position; memory is linear in its length."""
        tokens, fits = self.tokens, self.fits
        counts, starts = array("i", [0]) * (len(piece) + 1), array("i", [0]) * (len(piece) + 1)  # starts: of the prefix's last token
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, max(-1, i - self.longest - 1), -1):
                t = piece[j:i]
                if t in tokens:
                    last = piece[starts[j] : j]
                    ok = fits.get((last, t))
                    if self._side_by_side(last, t) if ok is None else ok:
                        counts[i], starts[i] = counts[j] + 1, j
                        break
        return np.array(counts, np.int32)

    def piece_counts(self, piece: bytes) -> np.ndarray:
        """Token counts of the piece's prefixes of 0, 1, 2 ... bytes."""
        if len(piece) > SHORT:
            return self._long_counts(piece)
        return np.cumsum(np.frombuffer(b"\0" + self._state(piece)[2], np.int8), dtype=np.int32)

    def _piece_steps(self, piece: str) -> bytes:
        """How the count changes with each code point of a piece, in 8-bit steps."""
        if piece in ("'re", "'ve", "'ll"):  # a part of a contraction is split otherwise
            counts = [0, *(sum(self._state(p.encode())[0] for p in self.pieces.findall(piece[:k])) for k in (1, 2)), self._state(piece.encode())[0]]
            return bytes((y - x) & 255 for x, y in zip(counts, counts[1:], strict=False))
        raw = piece.encode()
        if len(raw) > SHORT:
            ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
            return np.diff(self._long_counts(raw)[ends]).astype(np.int8).tobytes()
        steps = self._state(raw)[2]
        if len(raw) == len(piece):
            return steps
        out, at = bytearray(), 0
        for c in piece:
            end = at + len(c.encode())
            out.append(sum(steps[at:end]) & 255)
            at = end
        return bytes(out)

    def _chunk_steps(self, chunk: str) -> bytes:
        """The steps of a chunk; those of short chunks and pieces are remembered."""
        known, out = self.steps, []
        for piece in self.pieces.findall(chunk):
            steps = known.get(piece)
            if steps is None:
                steps = self._piece_steps(piece)
                if len(piece) <= SHORT:
                    if len(known) > CACHE // 2:
                        known.clear()
                    known[piece] = steps
            out.append(steps)
        if len(out) == 1:
            return out[0]
        steps = b"".join(out)
        if len(chunk) <= SHORT:
            known[chunk] = steps
        return steps

    def _run_counts(self, run: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2 ... blanks of a run."""
        found = self.runs.get(run)
        if found is None:
            found = self.piece_counts(run.encode())[np.cumsum([len(c.encode()) for c in run])]
            if len(run) <= SHORT:
                if len(self.runs) > CACHE // 16:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def _plain_prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, 2 ... code points of a text whose special strings are plain text."""
        chunks, known = _CHUNK.findall(text), self.steps
        try:
            steps = b"".join([known[c] for c in chunks])
        except KeyError:
            steps = b"".join([self._chunk_steps(c) if (x := known.get(c)) is None else x for c in chunks])
        out = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32, out=out[1:])
        for m in _RUN.finditer(text):  # a run of white space at a prefix's end is one piece
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + self._run_counts(m.group())
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the text's prefixes of 0, 1, 2 ... code points.

        Up to its last letter a special string is plain text that goes on with what stands before it.
        """
        if not self.special or not any(s in text for s in self.specials):
            return self._plain_prefixes(text)
        out, done, at = np.zeros(len(text) + 1, np.int32), 0, 0
        for m in self.special.finditer(text):
            start, end = m.span()
            plain = self._plain_prefixes(text[at : end - 1])
            out[at:end] = done + plain
            done += int(plain[start - at]) + 1
            out[end] = done
            at = end
        out[at:] = done + self._plain_prefixes(text[at:])
        return out

    def count(self, text: str) -> int:
        return int(self.prefixes(text)[-1])


def longest_fitting(counts: np.ndarray, budget: int) -> int:
    """The longest prefix of at most ``budget`` tokens, by the counts of all prefixes."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= budget))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _answered(path: str, columns: dict):
    """``doc_id``, then for each text what ``columns`` (name: type and function of text and counts) say of its prefixes' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path)
        for batch in batches:
            rows: list[list] = [[] for _ in columns]
            for t in batch["text"].to_pylist():
                t = t or ""
                counts = made.prefixes(t)
                for out, (_, of) in zip(rows, columns.values(), strict=True):
                    out.append(of(t, counts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, kind) for x, (kind, _) in zip(rows, columns.values(), strict=True))], ["doc_id", *columns])

    return run


_N_BYTES = (pa.int64(), lambda t, counts: len(t) if t.isascii() else len(t.encode()))
_N_TOKENS = (pa.int64(), lambda t, counts: int(counts[-1]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, tokenizer: str, prefixes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row and, with ``prefixes``, ``prefix_steps``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library with its own splitting pattern. ``prefix_steps`` is
    the zlib-compressed 8-bit change of the count from each code point to the next: their running sum is the exact
    number of tokens of every prefix (see :func:`tokens_at` and :func:`fitting_chars`). A null text is empty and has no
    tokens. Special strings in a text are special tokens. Repeated rows each give a row; other columns are ignored.
    """
    columns = {"n_bytes": _N_BYTES, "n_tokens": _N_TOKENS}
    if prefixes:
        columns["prefix_steps"] = (pa.binary(), lambda t, counts: zlib.compress(np.diff(counts).astype(np.int8).tobytes()))
    return _texts(docs).mapInArrow(_answered(tokenizer, columns), "doc_id long, n_bytes long, n_tokens long" + ", prefix_steps binary" * prefixes)


def _steps(data: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(data), np.int8).astype(np.int64))])


def tokens_at(prefix_steps: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points."""
    x = _steps(prefix_steps)
    return int(x[min(chars, len(x) - 1)])


def fitting_chars(prefix_steps: bytes, budget: int) -> int:
    """The longest prefix, in code points, of at most ``budget`` tokens."""
    return longest_fitting(_steps(prefix_steps), budget)


def budget_answers(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fitting_chars, prefix_crc32``: what the counts of all prefixes of each text tell.

    ``n_tokens`` is the last of them, ``fitting_chars`` the code points of the longest prefix of at most ``budget`` tokens,
    ``prefix_crc32`` the CRC-32 of all counts, from that of the empty prefix on, as little-endian 32-bit integers. All are read
    off one table for each text; nothing is encoded again. Texts as in :func:`token_counts`.
    """
    columns = {"n_bytes": _N_BYTES, "n_tokens": _N_TOKENS, "fitting_chars": (pa.int64(), lambda t, counts: longest_fitting(counts, budget)), "prefix_crc32": (pa.int64(), lambda t, counts: zlib.crc32(counts.astype("<i4", copy=False)))}
    return spread(_texts(docs)).mapInArrow(_answered(tokenizer, columns), "doc_id long, n_bytes long, n_tokens long, fitting_chars long, prefix_crc32 long")


def within_budget(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """``doc_id, n_tokens, fitting_chars, text``: each text cut to its longest prefix of at most ``budget`` tokens."""
    fit = lambda counts: longest_fitting(counts, budget)
    columns = {"n_tokens": _N_TOKENS, "fitting_chars": (pa.int64(), lambda t, counts: fit(counts)), "text": (pa.string(), lambda t, counts: t[: fit(counts)])}
    return _texts(docs).mapInArrow(_answered(tokenizer, columns), "doc_id long, n_tokens long, fitting_chars long, text string")
