"""Source divergence, token files and hard negatives against plain Python."""

import glob
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverbed.llm import divergence, hard_negatives, queries, token_files
from riverbed.llm.packing import _encoder

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


# source divergence


def plain_divergence(rows, least_docs, most_terms):
    docs, counts = defaultdict(set), defaultdict(Counter)
    groups = set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall(lower(text)):
            docs[lang, t].add(k)
            counts[lang, source][t] += 1
    out = set()
    for lang, source in groups:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least_docs]
        v = len(kept)
        share = lambda count, kept=kept, v=v: {t: 1 + (1_000_000_000 * (count[t] + 5)) // (sum(count[u] for u in kept) + 5 * v) for t in kept}
        own = share(counts[lang, source])
        ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        others = [(s, sum(abs(own[t] - q) for t, q in share(counts[lang, s]).items())) for x, s in groups if x == lang and s != source]
        out |= {(lang, source, "pair", item, value, rank) for rank, (item, value) in ranked(others)}
        whole = share(sum((counts[lang, s] for x, s in groups if x == lang), Counter()))
        terms = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        out |= {(lang, source, "term", item, value, rank) for rank, (item, value) in ranked(terms) if rank <= most_terms}
    return out


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    words = ["Wort", "wort", "été", "ÉTÉ", "don't", "x1y2", "中文", "a-b", "\U0001d4d0z", "tie", "eit"] + [f"w{'abcdefg'[k % 7]}{'hijk'[k % 4]}" for k in range(40)]
    rows = [("aa" if k % 3 else "bb", f"s{rng.randrange(4)}", " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(160)]
    rows += [("aa", "hot", "wort tie eit " * 50)] * 90  # a third of all rows
    rows += [(None, "s1", "tie"), ("", None, "eit"), ("aa", None, None), ("cc", "s1", "alone"), ("cc", "s2", None), ("dd", "only", ""), ("aa", "s9", "...1 2 3")]
    return rows + [("bb", "long", "wort " * 30_000 + "x" * 20_000)]


@pytest.mark.parametrize("least_docs,most_terms", [(30, 50), (5, 3), (500, 50)])
def test_divergence(spark, spoken, least_docs, most_terms):
    docs = spark.createDataFrame([(k if k % 9 else None, *r, 1.5) for k, r in enumerate(spoken)], "doc_id long, lang string, source string, text string, n double").repartition(5)
    found = [tuple(r) for r in divergence.source_divergence(docs, least_docs, most_terms).collect()]
    assert set(found) == plain_divergence(spoken, least_docs, most_terms) and len(found) == len(set(found))


def test_divergence_of_nothing(spark, empty):
    docs = empty.select("doc_id", F.lit("x").alias("lang"), F.lit("y").alias("source"), "text", F.lit(1).alias("n_docs"), F.lit(1).alias("term"), F.lit(1).alias("v"))
    assert divergence.source_divergence(docs).count() == 0
    one = spark.createDataFrame([(1, "l", "s", "a b")], "doc_id long, lang string, source string, text string")
    assert divergence.source_divergence(one).count() == 0  # no other source, no kept term
    assert [tuple(r) for r in divergence.frequent_terms(one, 1).orderBy("term").collect()] == [("l", "a", "s", 1, 1, 1, 1), ("l", "b", "s", 1, 1, 1, 1)]


def test_task_runs_are_summed_when_held_runs_overflow(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcd", k=4)) for _ in range(30)) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 50), pa.array([f"s{k % 3}" for k in range(50)]), pa.array(range(50), pa.int64()), pa.array(texts)], ["lang", "source", "doc_id", "text"])

    def totals():
        out = Counter()
        for b in divergence._task_runs(iter([batch, batch])):
            for _, t, s, _, d, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[t, s, "docs"] += d
                out[t, s, "n"] += n
        return out

    want = totals()
    monkeypatch.setattr(divergence, "HELD_RUNS", 100)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 500)
    assert totals() == want and sum(v for (*_, k), v in want.items() if k == "n") == 3000


def test_shares_are_exact_beyond_64_bits(spark):
    counts = [(9_999_999_999, 123_456_789_012_345, 10**9), (0, 0, 1), (10**15, 10**18, 7)]
    rows = spark.createDataFrame(counts, "c long, n long, v long").select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in rows] == [1 + (10**9 * (c + 5)) // (n + 5 * v) for c, n, v in counts]


# token files


def plain_tokens(rows):
    """Rows in file order with their ids."""
    t = Tokenizer.from_file(PATH)
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["one", "Two", "naïve", "中文", "<|endoftext|>", "xyzzy", "\n", "12345"], k=rng.randrange(60))) for _ in range(300)]
    rows = [(k * 7 % 1000, x) for k, x in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "  \n "), (5003, "long word " * 20_000), (-3, "first")]
    rows += [(77_777, f"copy {k % 2}") for k in range(150)]  # a third of all rows under one id
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(6)
    path = f"{tmp_path_factory.mktemp('tokens')}/all"
    token_files.write_tokens(docs, PATH, path, layout=token_files.Layout(row_group=1 << 12, page=1 << 10, page_rows=16), files=2)
    return path, rows


def test_tokens_come_back(spark, written):
    path, rows = written
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in token_files.read_tokens(spark, path).collect())
    at = 0
    for start, _, n, ids in found:
        assert (start, n) == (at, len(ids))
        at += n
    assert [d for _, d, _, _ in found] == sorted(d for d, _ in rows)
    assert sorted((d, ids) for _, d, _, ids in found) == sorted(plain_tokens(rows))
    digests = {tuple(r) for r in token_files.token_digests(token_files.read_tokens(spark, path)).collect()}
    assert digests == {(d, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for s, d, n, ids in found}


def test_files_have_the_layout(spark, written):
    path, _ = written
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    assert len(files) == 2
    kinds, groups = defaultdict(set), 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                kinds[column.path_in_schema] |= set(column.encodings)
                assert column.has_column_index and column.has_offset_index and column.compression == "ZSTD"
    assert groups > len(files)  # row groups end at the set size
    assert "RLE_DICTIONARY" in kinds["ids.list.element"]
    for c in ("doc_id", "at", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in kinds[c] and "RLE_DICTIONARY" not in kinds[c]


def scanned(df):
    """Rows that the scan of the token files gave on."""
    rows, plan = df.collect(), df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan
    return rows, plan


def test_selective_reads(spark, written):
    path, rows = written
    want = sorted((d, ids) for d, ids in plain_tokens(rows) if d is not None and 300 <= d <= 420)
    found, plan = scanned(token_files.read_tokens(spark, path, 300, 420))
    assert sorted((r["doc_id"], r["ids"]) for r in found) == want and "GreaterThanOrEqual(doc_id,300)" in plan
    meta = token_files.read_tokens(spark, path).select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]  # the lists aren't read


def test_spans(spark, written):
    path, _ = written
    whole = [i for r in sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    n = len(whole)
    for begin, length in ((0, 1), (0, n), (n - 5, 50), (1234, 3000), (n // 2, 20_000), (n, 10), (10, 0), (-5, 20)):
        got = sorted(tuple(r) for r in token_files.read_span(spark, path, begin, length).collect())
        at = {s: ids for _, s, ids in got}
        joined = [i for s in sorted(at) for i in at[s]]
        assert joined == whole[max(0, begin) : max(0, begin + length)]
        assert all(whole[s : s + len(ids)] == ids for _, s, ids in got)


def test_tokens_of_odd_tables(spark, empty, tmp_path):
    token_files.write_tokens(empty, PATH, f"{tmp_path}/none")
    assert token_files.token_digests(token_files.read_tokens(spark, f"{tmp_path}/none")).count() == 0
    assert token_files.read_span(spark, f"{tmp_path}/none", 0, 10).count() == 0
    docs = spark.createDataFrame([(None, "b"), (2, "c"), (1, None), (None, "b")], "doc_id long, text string")
    token_files.write_tokens(docs, PATH, f"{tmp_path}/some")
    rows = sorted((r["start"], r["doc_id"], r["ids"]) for r in token_files.read_tokens(spark, f"{tmp_path}/some").collect())
    b, c = (Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids for x in "bc")
    assert rows == [(0, None, [*b, 1]), (2, None, [*b, 1]), (4, 1, [1]), (5, 2, [*c, 1])]


def test_token_query(spark):
    from tests.test_queries import SF

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    at, want = 0, set()
    for d, ids in plain_tokens(docs):
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in queries.op12_token_files(spark, SF).collect()} == want


def test_encoder_ends():
    assert _encoder(PATH, 1).ids([b"", b"a"])[0] == b"\x01\0\0\0"


# hard negatives


def plain_negatives(rows, every, n_pos, n_neg, window):
    kept = {}
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * x) for x in e]
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        ranked = sorted((-score(v, w), b, other == label) for b, (other, w) in kept.items() if b != a)
        for ps, p, _ in [x for x in ranked if x[2]][:n_pos]:
            fits = [x for x in ranked if not x[2] and window[0] * -ps <= 100 * -x[0] <= window[1] * -ps][:n_neg]
            out |= {(a, p, k, b, -ps, -ns) for k, (ns, b, _) in enumerate(fits, 1)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    f32 = lambda x: np.asarray(x, np.float32).tolist()
    rows = [(k, int(rng.integers(4)), f32(rng.normal(size=9) / 3)) for k in range(600)]
    rows += [(600 + k, k % 3, f32(np.full(9, 0.21))) for k in range(300)]  # one vector, a third of all rows
    rows += [(900 + k, k % 4, f32(np.round(rng.normal(size=9)) / 4)) for k in range(100)]  # ties
    rows += [(1000, 1, [1.0, float("nan")] + [0.0] * 7), (1001, None, f32(np.ones(9))), (1002, 1, None), (1003, 1, [None] * 9), (1004, 2, [float("inf")] * 9), (None, 1, f32(np.ones(9)))]
    rows += [(1005, 1, []), (1010, 1, f32(np.ones(5))), (1020, 77, f32(np.ones(9))), (1030, -2, f32(np.zeros(9))), (1040, 1, f32(1000 * np.ones(9))), (1050, 2, f32(-np.ones(9)))]
    return rows + [rows[10], (20, 0, f32(np.ones(9))), (-10, 3, f32(rng.normal(size=9)))]


@pytest.mark.parametrize("block_rows,n_pos,n_neg,window", [(None, 5, 5, (80, 100)), (100, 5, 5, (80, 100)), (37, 2, 9, (50, 90))])
def test_hard_negatives(spark, vectors, block_rows, n_pos, n_neg, window):
    rows = spark.createDataFrame([(*r, 1.0, "x") for r in vectors], "vec_id long, label int, embedding array<float>, v double, codes string").repartition(3)
    found = [tuple(r) for r in hard_negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0, n_pos, n_neg, window, fit_rows=200, block_rows=block_rows).collect()]
    want = plain_negatives(vectors, 10, n_pos, n_neg, window)
    assert set(found) == want and len(found) == len(want) and len({a for a, *_ in want}) > 50


def test_negatives_of_nothing(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, None, None)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    v = rng.integers(-90, 90, (3000, 64))
    c = rng.normal(size=(32, 256, 2)) * 50
    book = hard_negatives.Codebook(c)
    codes, norms = book.encode(v)
    table = pa.table({"vec_id": np.arange(3000), "label": np.zeros(3000, np.int64), "v": v.tolist(), "codes": [x.tobytes() for x in codes], "residuals": [x.tobytes() for x in norms]})
    block = hard_negatives._Block(table, book)
    low, high = block.bounds(v[:50], slice(0, 3000))
    true = v[:50] @ v.T
    assert (low <= true).all() and (true <= high).all()
    assert (high >= np.sort(low, 1)[:, [-6]]).mean() < 0.1  # few rows are left to multiply


def test_commonest_words_are_those_of_a_sort(spark):
    """Without a sort that one task ends (F1)."""
    import random

    from pyspark.sql import functions as F

    from riverbed.llm import lm_scores

    rng = random.Random(2)
    counts = spark.createDataFrame([(rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 1, 1, 2, 3, 40])) for _ in range(3000)], "h long, c long")
    for most in (1, 50, 700, 2000, 2999, 3000, 9000):
        found = lm_scores.commonest(counts, most)
        assert found.orderBy(F.desc("c"), "h").limit(most).collect() == counts.orderBy(F.desc("c"), "h").limit(most).collect()
        assert found.count() < most + 20 and "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
    assert lm_scores.commonest(counts.where("false"), 5).count() == 0
