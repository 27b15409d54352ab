"""The operators against plain Python on texts with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverbed.llm import common, decontamination, jaccard, kernels, licenses, line_dedup, lm_scores, packing, quality, secrets, token_counts, toxicity
from riverbed.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def collected(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)


def test_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["abcdefgh abcdefghi abcdefg", "ABCDEFGH abcdefgh ", None, "", "a" * 100 + " " + "a" * 101]
    data, offsets = kernels.buffers(pa.array(texts))
    words = kernels.Words(data, offsets, 0, len(texts))
    h = words.hashes()
    found = kernels.strings(words.text, words.start, words.end)
    assert found == [w.encode() for t in texts for w in WORD.findall(lower(t))]
    assert len(set(h.tolist())) == len(set(found)) and h[0] == h[3]


# secrets


def spans_of(text, rules):
    out = []
    for rank, r in enumerate(rules):
        pattern = re.compile(r.pattern)
        out += [(m.start(), rank, m.end(), r.kind) for m in pattern.finditer(text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secrets(docs, rows, empty):
    found = secrets.secret_spans(docs)
    got = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["spans"]]) for r in found.collect()), key=repr)
    want = sorted(((r[0], r[1] or "", [(a, k, b, kind) for a, k, b, kind in spans_of(r[1], secrets.RULES)]) for r in rows), key=repr)
    assert got == want
    assert sum(len(s) for *_, s in got) == 7
    assert secrets.secret_spans(empty).count() == 0


def test_short_hex_runs_take_no_place():
    text = "0123abcd " * 3 + "a" * 23 + "g" + "a" * 24
    plain = [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [m.span() for m in plain] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]


def test_trigram_queries_are_necessary():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in ("password = abcdefgh", "API_KEY:'abcdefgh'", "apikey=abcdefgh", "AKIA" + "A" * 20, "ghs_" + "a" * 40, "AIza" + "b" * 40, "xoxb-1234567890", "-----BEGIN EC PRIVATE KEY-----", "eyJhbGci.eyJzdWIi.abc"):
            if re.search(rule.pattern, text) and query:
                assert any(all(t in text.lower() for t in clause) for clause in query)
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("abc|de") is None
    assert secrets.trigram_query("ab(c|d)e") == {frozenset({"abc", "bce"}), frozenset({"abd", "bde"})}


# n-gram Jaccard


def shingle_set(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets, parent = [(r[0], shingle_set(r[1], n)) for r in rows], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [(d, len(s), root(d) if d is not None and s else d) for d, s in sets]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, rows, n, percent):
    got = collected(jaccard.ngram_jaccard_join(docs, n, percent), "doc_id", "n_shingles", "component_id")
    assert [r for r in got if r[0] is not None] == sorted((r for r in brute_components(rows, n, percent) if r[0] is not None), key=repr)
    assert sum(r[0] is None for r in got) == 2


def test_jaccard_second_round(spark):
    """A chain of near copies, each linked with its neighbours only."""
    import random

    rng, words = random.Random(2), [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[rng.randrange(120)] = f"new{k}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 95):
        got = collected(jaccard.ngram_jaccard_join(docs, 3, percent), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute_components(rows, 3, percent), key=repr)


def test_jaccard_hot_lists(spark, docs, rows, monkeypatch):
    """Lists dealt to lots, and a sketch of another size, give the same components."""
    monkeypatch.setattr(jaccard, "HOT_TEXTS", 3)
    monkeypatch.setattr(jaccard, "BITS_ROWS", 16)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 4)
    got = collected(jaccard.ngram_jaccard_join(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert [r for r in got if r[0] is not None] == sorted((r for r in brute_components(rows, 3, 90) if r[0] is not None), key=repr)
    rng = np.random.default_rng(3)
    base, near = [f"w{x}" for x in rng.integers(0, 10**6, 200)], []
    for k in range(60):  # all near one text, less near each other
        words = list(base)
        for x in rng.integers(0, 200, 3):
            words[x] = f"x{k}"
        near.append((k, " ".join(words)))
    table = spark.createDataFrame(near, "doc_id long, text string").repartition(5)
    assert collected(jaccard.ngram_jaccard_join(table, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(brute_components(near, 3, 90), key=repr)


def test_jaccard_empty(empty):
    assert jaccard.ngram_jaccard_join(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 150), (150, 120), (7, 7), (200, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).select("node", "component").collect())
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 150: 100, 120: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# packing


def test_first_fit_decreasing():
    lengths = [7, 5, 5, 4, 3, 3, 2, 1]
    bins = packing.first_fit_decreasing(lengths, 10)
    fill, expected = [], []
    for n in lengths:
        k = next((i for i, f in enumerate(fill) if f + n <= 10), len(fill))
        fill += [0] * (k == len(fill))
        expected.append((k, fill[k]))
        fill[k] += n
    assert bins == expected
    assert packing.first_fit_decreasing([], 10) == []


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, size=64, group_pieces=16).collect()
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[r[0], s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(p.length for p in pieces) > 0.8 * 64 * len(sequences)
    assert packing.pack(empty, path).count() == 0


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 8)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 4)
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"word{k}, It's" for k in range(50))
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.WordEncoder(path, 1).ids([text.encode(), b""]) == [np.array([*ids, 1], "<u4").tobytes(), np.array([1], "<u4").tobytes()]


def test_word_encoder_on_odd_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, 1)
    odd = [chr(c) for c in (*range(0x250), 0x301, 0x345, 0x37E, 0x3A3, 0x110B, 0x1161, 0x200D, 0x212A, 0x3000, 0xAC00, 0xFB01, 0x1D400)]
    texts = [t for c in odd for t in (c, f"{c}.", f"a{c}!", f"{c}A?!", f"a.{c}", f"Wo{c}rt's, ")]
    want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert [t for t, ids, x in zip(texts, encoder.ids([t.encode() for t in texts]), want, strict=True) if ids != x] == []


def test_word_encoder_learns_a_word_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, asked = packing.WordEncoder(path, 1), []
    monkeypatch.setattr(encoder, "_encode", lambda words, encode=encoder._encode: (asked.extend(words), encode(words)))
    marks = [",", ".", "!", "...", ""]
    encoder.ids([f"Wort{m} \u00e9t\u00e9{m}".encode() for m in marks])
    assert {w for w in encoder.known if w} == {b"wort", "\u00e9t\u00e9".encode(), *(m.encode() for m in marks if m)}  # not with each mark again
    assert sorted(asked) == sorted(m.encode() for m in marks if m)  # letters, accents too, go straight to the model


@pytest.mark.parametrize("words", [1, 3])
def test_word_encoder_takes_words_in_parts(monkeypatch, words):
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", words)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "  ", " one two, ", "\u3000 \u3000 \u3000 \u3000", "a b c d e f g", "", "<|endoftext|> END", None]
    want = [np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert packing.WordEncoder(path, 1).ids(pa.array(texts)) == want
    assert packing.WordEncoder(path, 1).ids([]) == []


def test_texts_are_sliced_by_bytes():
    texts = pa.array(["abc", None, "", "defgh", "ij", "k" * 50, "l"], pa.string())
    assert [x.to_pylist() for x in packing.text_slices(texts, 6)] == [["abc", None, ""], ["defgh"], ["ij"], ["k" * 50], ["l"]]
    assert list(packing.text_slices(texts.slice(0, 0), 6)) == []


# language model


def test_lm_scores(docs, rows, empty):
    tokens = [(r[0], [*WORD.findall(lower(r[1])), "\0end"]) for r in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in tokens if not held(d) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
    want = sorted(((d, held(d), len(t), sum(counts[w] > 0 for w in t), total, round(base(t), 6)) for d, t in tokens), key=repr)
    got = lm_scores.lm_scores(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)
    assert lm_scores.lm_scores(empty).count() == 0


def test_lm_joined_words(docs, monkeypatch):
    """Words beyond the head are joined; the scores don't depend on where the head ends."""
    whole = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in lm_scores.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_scores, "HEAD_WORDS", lm_scores.COMMON + 20)
    for r in lm_scores.lm_scores(docs).collect():
        n, base, score = whole[r.doc_id, r.n_tokens]
        assert (r.n_known, round(r.base_score, 6)) == (n, round(base, 6)) and score == pytest.approx(r.score, rel=1e-4)


def test_lm_scores_wait_for_no_small_table(docs):
    """What the driver knows stands in the plan: a table of it would be a job behind the tasks of a long stage, and run out of time."""
    plan = lm_scores.LanguageModel(docs).scores(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    counts = np.full(lm_scores.UNITS, 1000.0)
    model = lm_scores.start(counts)
    every, n = np.arange(lm_scores.UNITS), 40
    for before in rng.integers(0, lm_scores.UNITS, (3, n)):
        rows = np.concatenate([np.tile(before, (lm_scores.UNITS, 1)), every[:, None]], 1)
        own = np.repeat(np.arange(len(rows)) * (n + 1), n + 1)
        seen = lm_scores.Context(rows.ravel(), own, 0, rows.size)
        assert np.exp(model.log_probabilities(seen)[n :: n + 1]).sum() == pytest.approx(1, abs=1e-3)
    trainer = lm_scores.Trainer(model, counts)
    unit = np.tile(np.arange(8), 4000)  # each unit follows the one before it
    seen = lm_scores.Context(unit, np.zeros(len(unit), np.int64), 0, len(unit))
    first = model.log_probabilities(seen).mean()
    trainer.learn(unit, np.zeros(len(unit), np.int64))
    assert model.log_probabilities(seen).mean() > first + 1


def test_lm_contexts_in_slices():
    """A slice sees what the whole run sees; nothing before a text's own beginning."""
    rng = np.random.default_rng(1)
    unit, own = rng.integers(0, lm_scores.UNITS, 500), np.repeat([0, 3, 200, 201], [3, 197, 1, 299])
    model = lm_scores.start(np.ones(lm_scores.UNITS))
    whole = model.guesses(lm_scores.Context(unit, own, 0, 500))[0]
    parts = [model.guesses(lm_scores.Context(unit, own, s, min(s + 60, 500)))[0] for s in range(0, 500, 60)]
    assert np.allclose(whole, np.concatenate(parts), atol=1e-5)
    alone = model.guesses(lm_scores.Context(unit[201:], np.zeros(299, np.int64), 0, 299))[0]
    assert np.allclose(whole[201:], alone, atol=1e-5)


def test_lm_gradients():
    """The training step goes down the slope of the loss, as differences show."""
    rng, counts = np.random.default_rng(2), np.full(lm_scores.UNITS, 50.0)
    unit, own = rng.integers(0, 20, 60), np.repeat([0, 25], [25, 35])
    last = np.repeat([24, 59], [25, 35])
    seen = lm_scores.Context(unit, own, 0, 60)

    def loss(m):
        t = lm_scores.Trainer(m, counts)
        noise = t.rng.choice(lm_scores.UNITS, lm_scores.NOISE, p=t.share)
        guess = m.guesses(seen)[0].astype(np.float64)
        true = (guess * m.target[unit]).sum(1) + m.bias[unit] - t.log_noise[unit]
        false = guess @ m.target[noise].T + m.bias[noise] - t.log_noise[noise]
        return np.logaddexp(0, -true).mean() + np.logaddexp(0, false).sum(1).mean()

    slopes = lm_scores.start(counts)
    trainer = lm_scores.Trainer(slopes, counts, [np.full_like(x, 1e2) for x in slopes.arrays()])
    before = [x.copy() for x in slopes.arrays()]
    trainer.batch(seen, last)  # steps of slope * RATE / 10
    for k, (x, y) in enumerate(zip(before, slopes.arrays(), strict=True)):
        slope = (x.astype(np.float64) - y) * 10 / lm_scores.RATE
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        moved = lm_scores.start(counts)
        moved.arrays()[k][at] += 0.05
        other = lm_scores.start(counts)
        other.arrays()[k][at] -= 0.05
        assert (loss(moved) - loss(other)) / 0.1 == pytest.approx(slope[at], rel=0.02)


@pytest.mark.parametrize("sf, gain", [("sf0.01", 0.25), ("sf0.1", 0.3)])
def test_lm_beats_its_base(spark, sf, gain):
    """Held out, by log10 a token; however the rows are partitioned."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = []
    for n in (1, 32) if sf == "sf0.01" else (4,):
        rows = lm_scores.lm_scores(docs.repartition(n)).where("held_out")
        found.append(rows.selectExpr("sum(score - base_score) / sum(n_tokens)", "sum(score)").first())
        assert found[-1][0] > gain
    assert found[0][1] == pytest.approx(found[-1][1], rel=1e-6)


def test_decontamination(spark, docs, rows, empty):
    texts = {r[0]: r[1] for r in rows}
    words = (texts[7] or "").split()
    items = [(1, " ".join(words[100:140])), (2, " ".join([*words[300:330], "never", "seen", *words[332:350]])), (3, "not in any text at all, this one"), (4, None), (5, "  "), (6, "two words"), (7, " ".join(words[50:60] + ["q"] * 10)), (1, " ".join(words[100:140])), (None, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    union = defaultdict(set)
    for d, t, *_ in rows:
        for n in (2, 5):
            w = WORD.findall((t or "").lower())
            union[d] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for k, t in items:
        w = WORD.findall((t or "").lower())
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for d, x in union.items():
            if s and k is not None and d is not None and 100 * len(s & x) >= 80 * len(s):
                want.add((d, k, len(s), len(s & x)))
    assert {tuple(r) for r in decontamination.contaminated(docs, benchmark).collect()} == want
    assert (7, 1, 36, 36) in want and any(k == 6 for _, k, *_ in want)
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0


def test_decontamination_shared_line(spark, monkeypatch):
    """A line that a thousand items hold makes no pairs but those that verify; a document of three rows is one."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    prompt = "answer the question below by one of the letters a to d"
    items = [(k, f"{prompt} {words(6 + k % 60)}") for k in range(1000)]
    texts = [(k, f"{words(30)} {items[k][1]} {words(20)}") for k in range(0, 1000, 50)] + [(5000 + k, f"{words(9)} {prompt} {words(9)}") for k in range(30)]
    first, rest = items[77][1].split()[:20], items[77][1].split()[16:]
    texts += [(9000, " ".join(first)), (9000, " ".join(rest)), (9000, "one")]
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 7)
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    union, sets = defaultdict(set), {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in items}
    for d, t in texts:
        union[d] |= {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {(d, k, len(s), len(s & x)) for d, x in union.items() for k, s in sets.items() if 100 * len(s & x) >= 80 * len(s)}
    assert {tuple(r) for r in decontamination.contaminated(docs, benchmark).collect()} == want and len(want) >= 21


# licenses


def test_licenses(docs, rows, empty):
    separators = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for d, t, *_ in rows:
        w = separators.findall(lower(t))
        at = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = licenses.license_scan(docs)
    assert collected(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r.labels for r in got.collect()}
    assert {"", "mit", "apache-2", "cc-by-nc", "gpl-3"} <= labels
    assert licenses.license_scan(empty).count() == 0


def test_template_automaton():
    ids: dict[str, int] = {}
    a = licenses.Automaton("x", "[[this {{2}} is]] licensed under the [[terms of the]] y license", ids)
    run = lambda s: a.run([ids.get(w, -1) for w in s.split()])[0]
    assert run("licensed under the y license") and run("this is licensed under the terms of the y license and more")
    assert run("this very work is licensed under the y license")
    assert not run("this very long work is licensed under the y license")
    assert not run("licensed under the terms y license") and not run("licensed under the z license")


def test_license_notices_without_rare_words(spark):
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = [gnu.format("", 2), gnu.format("", 3), gnu.format("Lesser ", 3), "Redistribution and use in source and binary forms, with or without modification,", "This source code form is subject", "no notice", "modification"]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.labels, r.score) for r in rows}
    must = {a.label: a.must for a in licenses.Scanner().automata}
    assert got == {0: ("gpl-2", 1), 1: ("gpl-3", 1), 2: ("lgpl-3", 1), 3: ("", 12 / must["bsd-2"]), 4: ("", 6 / must["mpl-2"]), 5: ("", 0), 6: ("", 0)}


def _filled(markup: str, regions: bool, name: str = "the copyright holders") -> str:
    """A text of the template: with or without its optional regions, the replaceable ones filled."""
    text = re.sub(r"\[\[(.*?)\]\]", r"\1" if regions else "", markup.replace("[[[[", "[[").replace("]]]]", "]]"))
    return re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(name.split()[: int(m[1])]), text)


def test_license_bodies_are_told_apart():
    """Each body has its own label only, with its regions filled or left out; a changed mandatory word is refused."""
    scanner = licenses.Scanner()
    ids = {w.decode(): k for k, w in enumerate(scanner.words)}
    labels = lambda text: scanner.matches([ids.get(w, -1) for w in text.split()])[0]
    for label, markup in licenses.TEMPLATES:
        for regions in (True, False):
            text = _filled(markup, regions)
            assert labels("some words before " + text + " and behind") == {label}
        words = _filled(re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", " ", markup), False).split()
        for k in range(0, len(words), 1 + len(words) // 25):
            assert label not in labels(" ".join([*words[:k], "zebra", *words[k + 1 :]]))
    assert labels(_filled(f"{licenses.BSD_GRANT} {licenses.BSD_NAMES} {licenses.BSD_DISCLAIMER}", True)) == {"bsd-3"}


def test_license_labels_against_expressions():
    """Templates as regular expressions over the words give the same labels."""

    def expression(markup):
        parts = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", markup):
            parts.append("(?:" if part == "[[" else ")?" if part == "]]" else rf"(?:\S+ ){{0,{part[2:-2]}}}" if part.startswith("{{") else re.escape(part) + " ")
        return re.compile("(?:^|(?<= ))" + "".join(parts))

    rng = np.random.default_rng(8)
    scanner = licenses.Scanner()
    ids = {w.decode(): k for k, w in enumerate(scanner.words)}
    made = [(label, expression(m)) for label, m in licenses.TEMPLATES]
    for _ in range(150):
        words = []
        for k in rng.integers(0, len(made), 3):
            part = _filled(licenses.TEMPLATES[k][1], bool(rng.integers(0, 2)), "jane doe and her friends").split()
            words += ["this", "work", "is"] * int(rng.integers(0, 2)) + [w for w in part if rng.random() < rng.choice([1.0, 0.999])]
        text = " ".join(words) + " "
        assert scanner.matches([ids.get(w, -1) for w in words])[0] == {label for label, e in made if e.search(text)}


def test_license_starts_lose_nothing():
    """Every template at every word gives the same labels and score."""
    rng = np.random.default_rng(6)
    scanner = licenses.Scanner()
    parts = [re.sub(r"[^a-z0-9 ]", " ", m).split() for _, m in licenses.TEMPLATES]
    ids = {w.decode(): k for k, w in enumerate(scanner.words)}
    for _ in range(300):
        words = [ids.get(w, -1) for k in rng.integers(0, len(parts), 3) for w in ["this", "work", "is"] * int(rng.integers(0, 2)) + parts[k] if rng.random() < 0.95]
        runs = [(a.label, *a.run(words[k:])) for a in scanner.automata for k in range(len(words))]
        assert scanner.matches(words) == ({label for label, ok, _ in runs if ok}, max((x for *_, x in runs), default=0.0))


# quality


def test_quality(docs, rows, empty):
    field = quality.Field(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked), failed, not failed))
    got = quality.quality_verdicts(docs, field)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=repr)
    assert quality.quality_verdicts(empty, field).count() == 0


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    sizes = [4, 0, 1, 7, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(first[-1], 2))
    got = field.viterbi(scores, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda y, a=a: sum(scores[a + k, v] for k, v in enumerate(y)) + sum(field.move[p, q] for p, q in zip(y, y[1:], strict=False))
        if b > a:
            assert tuple(got[a:b]) == max(product((0, 1), repeat=int(b - a)), key=value)


def test_quality_learns(spark):
    rows = [(k, "\n".join(["A plain sentence with some words in it."] * 3)) for k in range(40)] + [(k, "\n".join(["BUY!! NOW!! $$$ ### CHEAP!!"] * 3)) for k in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80) if k % 2], "doc_id long, label int")
    shares = {r.doc_id: r.content_share for r in quality.quality_verdicts(docs, quality.train(docs, labels)).collect()}
    assert all(s == 1 for k, s in shares.items() if k < 40) and all(s == 0 for k, s in shares.items() if k >= 40)
    nothing = quality.train(docs, labels.where("false"))
    assert all(r.content_share == 1 for r in quality.quality_verdicts(docs, nothing).collect())


def test_quality_learns_from_late_lines(spark):
    """Good and bad texts differ only behind their first 450 lines."""
    plain, junk = [f"Plain sentence {k} with some words." for k in range(900)], ["BUY!! NOW!! $$$ ### CHEAP!!"]
    rows = [(k, "\n".join(plain[:450] + (plain[450:] if k % 2 else junk * 450))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, label int")
    found = {r.doc_id: r for r in quality.quality_verdicts(docs, quality.train(docs, labels)).collect()}
    assert all(found[k].content_share == 1 and found[k].boilerplate == [] for k in (1, 3, 5, 7))
    assert all(found[k].boilerplate == list(range(450, 900)) for k in (0, 2, 4, 6))


def test_quality_labels_change_inside_a_text(spark):
    """A page's header of menus before good text: line by line, and the page stays."""
    rng = np.random.default_rng(4)
    words = [f"word{x}" for x in range(300)]
    sentence = lambda: " ".join(rng.choice(words, 14)).capitalize() + "."
    menu = lambda: " | ".join(x.upper() + "!!" for x in rng.choice(words, 3)) + " $$ ##"
    texts = []
    for k in range(300):
        good = k % 3 > 0
        header = [menu() for _ in range(int(rng.integers(0, 3 if good else 1)))]
        texts.append(header + ([sentence() for _ in range(8)] if good else [sentence()] + [menu() for _ in range(9)] + [sentence()]))
    texts.append([menu(), menu(), menu(), *[sentence() for _ in range(9)], menu()])
    docs = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, label int")
    found = {r.doc_id: r for r in quality.quality_verdicts(docs, quality.train(docs, labels)).collect()}
    assert found[300].boilerplate == [0, 1, 2, 12] and found[300].kept
    for k in range(200, 300):
        assert found[k].boilerplate == [n for n, line in enumerate(texts[k]) if "$$" in line]
        assert found[k].kept == (k % 3 > 0)


def test_quality_fit_in_batches(monkeypatch):
    rng = np.random.default_rng(2)
    targets = [rng.integers(0, 2, rng.integers(1, 40)).astype(np.int8) for _ in range(30)]
    texts = [np.array([1 | int(rng.integers(0, 1 << (4 + 9 * int(y)))) << 1 for y in t], np.uint16) for t in targets]
    whole = quality.fit(texts, targets, rounds=20)
    monkeypatch.setattr(quality, "BATCH_LINES", 50)
    parts = quality.fit(texts, targets, rounds=20)
    assert np.allclose(whole.emit, parts.emit) and np.allclose(whole.move, parts.move)


def test_quality_gradients():
    """At the end of the fit, expected features and pairs are those seen (but for the decay)."""
    rng = np.random.default_rng(5)
    targets = [np.sort(rng.integers(0, 2, 12)).astype(np.int8) for _ in range(40)]
    texts = [(1 | (t.astype(np.uint16) << 1) ^ (rng.random(12) < 0.2).astype(np.uint16) << 1).astype(np.uint16) for t in targets]
    field = quality.fit(texts, targets, rounds=400, decay=0.0)
    scores = np.arange(1 << quality.N_FEATURES)[:, None] >> np.arange(quality.N_FEATURES) & 1
    bits = np.stack(texts, 1)
    expected, pair = quality._expected(bits, np.full(40, 12), np.full(40, 1.0), scores @ field.emit, field.move)
    seen = np.stack([np.bincount(np.concatenate([x[t == y] for x, t in zip(texts, targets, strict=True)]), minlength=1 << quality.N_FEATURES) for y in (0, 1)], 1)
    assert np.allclose(scores.T @ expected, scores.T @ seen, atol=3)
    assert np.allclose(pair, sum(np.bincount(2 * t[:-1] + t[1:], minlength=4).reshape(2, 2) for t in targets), atol=3)
    assert field.viterbi((scores @ field.emit)[texts[0]], np.array([0, 12])).tolist() == sorted(field.viterbi((scores @ field.emit)[texts[0]], np.array([0, 12])).tolist())


def test_quality_held_out(spark):
    """Labels that training hasn't seen: bad documents go, good ones stay."""
    from riverbed.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = [r for r in queries.op7_quality_rules(spark, sf).join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.kept for r in rows if r.quality]) > 0.95 and np.mean([r.kept for r in rows if not r.quality]) < 0.03


# line dedup


def kept_text(rows, least_docs=5, least_chars=40):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if d is None or len(holders[key(x)]) < least_docs or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_line_dedup(spark, docs, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collected(line_dedup.line_digests(docs, line_dedup.line_keep_bitmaps(docs)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in kept_text(rows)), key=repr)
        assert sum(r[2] for r in got) == 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_line_dedup_hot_line(spark):
    line = "one line that stands in all of these documents, again and again"
    rows = [(k, f"{line}\nown line of document {k} with enough characters in it\n{line}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        kept = collected(line_dedup.drop_shared_lines(docs), "doc_id", "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert kept == sorted(((d, t) for d, _, _, t in kept_text(rows)), key=repr)


def test_drop_shared_lines_keeps_columns(docs, rows, empty):
    out = line_dedup.drop_shared_lines(docs)
    assert out.columns == docs.columns
    want = sorted(((r[0], None if r[1] is None else t, r[2], None if r[1] is None else len(t)) for r, (_, _, _, t) in zip(rows, kept_text(rows), strict=True)), key=repr)
    assert collected(out, "doc_id", "text", "row", "n_chars") == want
    assert line_dedup.drop_shared_lines(empty).count() == 0
    odd = docs.withColumnsRenamed({"row": "a.b", "h": "_", "label": "blank`x"})
    assert line_dedup.drop_shared_lines(odd).columns == odd.columns
    assert Counter((r["a.b"], r["text"]) for r in line_dedup.drop_shared_lines(odd).collect()) == Counter((r[2], r[1]) for r in want)


# toxicity


def test_toxicity(spark, docs, rows, empty):
    import random

    rng, words = random.Random(1), [f"plain{k}" for k in range(300)]
    texts = []
    for k in range(400):
        bad = k % 4 == 0
        t = [rng.choice(words) for _ in range(40)] + (["Idiot!", "you,"] if bad else [])
        rng.shuffle(t)
        texts.append((k, " ".join(t), int(bad)))
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    machine = toxicity.train(table, table.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("label")))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, machine).collect()}
    assert all((scores[k] >= 0.3) == bool(y) for k, _, y in texts)
    assert toxicity.toxicity_scores(docs, machine).count() == len(rows)
    kept = toxicity.drop_toxic(table, machine)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {k for k, _, y in texts if not y}
    assert toxicity.drop_toxic(docs, machine).columns == docs.columns
    assert toxicity.toxicity_scores(empty, machine).count() == 0
    nothing = toxicity.train(table, table.where("false").select("doc_id", F.col("toxic").alias("label")))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(docs, nothing).collect())


def _machine_of(spark, texts):
    table = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    machine = toxicity.train(table, table.where("doc_id % 2 = 0").select("doc_id", "label"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, machine).collect()}
    return np.mean([(scores[k] >= 0.5) == (y == 1) for k, (_, y) in enumerate(texts) if k % 2])


def test_factorization_machine_pairs(spark):
    """Pairs of terms that each mean little or nothing alone, on texts that the machine hasn't seen."""
    rng = np.random.default_rng(0)
    plain = lambda: [f"plain{x}" for x in rng.integers(0, 30, 4)]
    either = []
    for _ in range(3000):  # one of two terms, but not both: neither alone tells anything
        a, b = map(bool, rng.random(2) < 0.5)
        either.append((" ".join(["alpha"] * a + ["beta"] * b + plain()), int(a != b)))
    assert _machine_of(spark, either) > 0.9
    both = []
    for _ in range(4000):  # a rare word counts only beside a common one
        rare, common = rng.random() < 0.15, rng.random() < 0.5
        both.append((" ".join(["rare"] * rare + ["common"] * common + plain()), int(rare and common)))
    assert _machine_of(spark, both) > 0.97


def test_toxicity_stems(spark):
    """Words that share their first letters with words seen in toxic texts."""
    rng = np.random.default_rng(1)
    ends = ["ab", "er", "ion", "ous", "ing", "el", "um", "ix", "ost", "ade"]
    rows = [(k, " ".join([f"plain{x}" for x in rng.integers(0, 99, 30)] + ["moronic" + ends[k // 2 % 5 + 5 * (k % 2)]] * (k % 10 < 3)), int(k % 10 < 3)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("label")))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, machine).collect()}
    assert all((scores[k] >= 0.3) == (y == 1) for k, _, y in rows if k % 2)


def test_labelled_sample(spark, docs):
    """Repeated ids give one text each; labels other than 0 and 1 and null ids none."""
    labels = spark.createDataFrame([(9, 0), (9, 1), (10, 0), (11, 7), (None, 1), (99999, 1)], "doc_id long, label int")
    assert sorted(r.label for r in common.labelled_sample(docs, labels, 10).collect()) == [0, 1]
    assert common.labelled_sample(docs, labels, 1).count() <= 1


def test_toxicity_held_out(spark):
    """The query's columns, and the share of held-out toxic documents that it finds."""
    from riverbed.llm import queries

    sf = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in held if r.toxic]) >= 0.9 and np.mean([r.predicted for r in held if not r.toxic]) < 0.01


# token counts


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows), key=repr)
    assert collected(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens") == want
    stored = token_counts.token_counts(docs.where("doc_id > 40"), path, prefixes=True).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in stored:
        t = texts[r.doc_id]
        for k in range(0, len(t) + 1, max(1, len(t) // 50)):
            assert token_counts.tokens_at(r.prefix_steps, k) == count(t[:k])
        k = token_counts.fitting_chars(r.prefix_steps, 5)
        assert count(t[:k]) <= 5 and all(count(t[:j]) > 5 for j in range(k + 1, min(len(t), k + 30) + 1))
    for r in token_counts.within_budget(docs.where("doc_id > 40"), path, 7).collect():
        assert count(r.text) <= 7
    assert token_counts.token_counts(empty, path, prefixes=True).count() == 0


def test_token_counts_long_runs():
    """Runs without a break: memory in proportion to the text, counts of all prefixes as the tokenizer's."""
    import tracemalloc

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    made = token_counts.PrefixCounter(path)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(letters), 6000)) for letters in ("acgt", "abcdefghijklmnop", "' ", "é語の", " \n\t", "'!-")] + ["'" * 3000, " " * 3000]
    tracemalloc.start()
    tables = [made.prefixes(t) for t in texts] + [made.prefixes("b" + texts[0])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for t, table in zip([*texts, "b" + texts[0]], tables, strict=True):
        assert made.count(t) == table[-1] == count(t)
        assert all(table[k] == count(t[:k]) for k in [*range(1, 200), *range(200, len(t), 307)])
    assert peak < 12 << 20


def test_token_counts_of_a_million_letters():
    """Runs of a million letters and of blanks within 300 MB of this process."""
    import resource

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    made = token_counts.PrefixCounter(path)
    text = "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    table = made.prefixes(text)
    blanks = made.prefixes(" " * 1_000_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert table[-1] == count(text) and table[77_777] == count(text[:77_777])
    assert blanks[50_000] == count(" " * 50_000)


def test_token_count_query(spark, rows, tmp_path):
    """The registered query: the limit, and what the prefix tables answer."""
    from riverbed.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = [None, "", "a few words", " ".join(f"number{k}" for k in range(300)), "x " * 511, "x " * 700, "ä\U0001f600" * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op10_token_counts(spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 512)
        assert count(t[: r.fitting_chars]) <= 512 and all(count(t[:k]) > 512 for k in range(r.fitting_chars + 1, min(len(t), r.fitting_chars + 20) + 1))
    made, rng = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(3)
    for _ in range(60):  # the longest prefix of all, with runs of white space and special strings about
        t = "".join(rng.choice(["a", "word ", "  ", " \n\t", "don't", "é語", "!?", "<|endoftext|>", " x"], int(rng.integers(1, 60)), p=[0.12] * 7 + [0.04, 0.12]))
        for budget in (0, 1, 5, 17):
            table = made.prefixes(t)
            assert (table[-1], token_counts.longest_fitting(table, budget)) == (count(t), max(k for k in range(len(t) + 1) if count(t[:k]) <= budget))


def test_digests_of_all_prefixes(spark, tmp_path):
    """The query's digest is that of the library's counts of every prefix of every text."""
    from riverbed.llm import queries
    from tests.test_queries import SF

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(r["doc_id"], (r["text"] or "")[:400]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [(10_000, "a<|endoftext|>"), (10_001, "<|endoftext|><|endoftext|> <|endo <|endoftext|"), (10_002, "x  \n\n <|endoftext|>  we'll don't'll 'r"), (10_003, ""), (10_004, "é語\u3000\u3000 \U0001f600" * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.prefix_crc32 for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    for d, t in texts:
        counts = [len(e.ids) for e in tokenizer.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
        assert got[d] == zlib.crc32(np.array(counts, "<i4").tobytes()), t


def test_special_strings_behind_a_long_run():
    """A special string behind half a million letters costs no more than the letters."""
    import time

    made = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    run, began = "q" * 250_000 + "z" * 250_000, time.time()
    table = made.prefixes(run + "<|endoftext|>" + "ab")
    assert time.time() - began < 60
    assert table[-1] == made.prefixes(run)[-1] + 1 + made.count("ab") and table[len(run) + 5] == made.prefixes(run[-1000:] + "<|end")[-1] - made.prefixes(run[-1000:])[-1] + table[len(run)]


def test_typographic_licenses(spark):
    """Curly quotes, dashes and signs don't hide a license; a changed mandatory word does; base columns see the text as it is."""
    fill = lambda m: re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\d+\}\}", "the authors", m))
    by = defaultdict(list)
    for label, markup in licenses.TEMPLATES:
        by[label].append(" ".join(fill(markup).split()))
    plain = {k: max(v, key=len) for k, v in by.items()}
    curly = {k: "\u00a9 2020\u2014" + v.replace("provided as is", "provided \u201cas is\u201d,").replace("express or implied", "express\u00a0or\u2009implied") for k, v in plain.items() if "provided as is" in v}
    assert {"mit", "isc", "0bsd", "zlib", "unlicense", "bsl-1"} <= set(curly)
    broken = {k: v.replace("\u201cas is\u201d", "\u201cas was\u201d") for k, v in curly.items()}
    quoted = "under the \u201cmit license\u201d"
    rows = [(n, t) for kind in (plain, curly, broken) for n, t in kind.items()] + [("quoted", quoted), (None, None)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    at = len(plain)
    assert all(n in got[k].labels.split(",") for k, (n, _) in enumerate(rows[: at + len(curly)]))
    assert not any(n in got[k + at + len(curly)].labels.split(",") for k, n in enumerate(broken))
    # the base phrase isn't there, as the marks belong to words; the method reads none either
    assert (got[len(rows) - 2].n_base, got[len(rows) - 2].n_words) == (0, 4) and got[len(rows) - 1].n_words == 0
    want = [len([w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]) for _, t in rows]
    assert [got[k].n_words for k in range(len(rows))] == want


def test_jaccard_with_a_crowded_sketch(spark, monkeypatch):
    """Where each counter stands for many shingles, lists of one text are still left out, and the groups are the same."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(150)]
    texts += [t + " more" for t in texts[:40]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("LEAST_BITS", 8), ("MOST_BITS", 8), ("HOT_TEXTS", 10), ("FIRST_STEP", 2), ("BLOOM_BITS", 11), ("MOST_BLOOM_BITS", 12), ("SLICES", 8)):
        monkeypatch.setattr(jaccard, name, value)
    lists = jaccard._Join(docs, 3, 90, 100).lists().collect()
    entities, hot = defaultdict(set), {r.h for r in lists if r.lot}
    for r in lists:
        entities[r.h].add(r.e)
    assert sum(r.lot > 0 for r in lists) < 0.05 * len(lists) and all(len(e) > 1 for h, e in entities.items() if h not in hot)
    got = collected(jaccard.ngram_jaccard_join(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(rows, 3, 90), key=repr)
