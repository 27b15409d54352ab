"""The pipeline and its stages against plain Python."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riverbed.llm import queries, toxicity
from tests.llm.test_operators import brute_components, kept_text, shingle_set


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Documents with toxic ones and ones that hold a test item, labels and test items."""
    at = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(f"term{x}" for x in rng.integers(0, 500, n))
    items = [(k, prose(20)) for k in range(6)]
    texts = list({r[0]: r for r in rows if r[0] is not None}.values())  # one row an id
    texts += [(1000 + k, prose(40) + (" you idiot moron " if k % 3 == 0 else " you good people ") + prose(20), None, None, None, k) for k in range(150)]
    texts += [(2000 + k, prose(30) + " " + items[k][1] + " " + prose(15), None, None, None, k) for k in range(6)]
    schema = "doc_id long, text string, row string, h string, label string, n_chars long"
    spark.createDataFrame(texts, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1000 + k, 1, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), texts, items


def near_copies_kept(rows):
    return [r for r, (d, _, c) in zip(rows, brute_components(rows, 5, 80), strict=True) if d == c]


def clean(rows, items):
    sets = [shingle_set(t, 5) for _, t in items]
    return [r for r in rows if not any(100 * len(s & shingle_set(r[1], 5)) >= 80 * len(s) for s in sets)]


def pieces(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            out[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    return out


def test_run(spark, folder):
    at, rows, items = folder
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.read.parquet(f"{at}/documents.parquet"), queries.toxicity_machine(spark, at)).collect()}
    assert all((scores[1000 + k] >= 0.3) == (k % 3 == 0) for k in range(150))
    left = [r for r in rows if scores[r[0]] < 0.3]
    left = [(d, t if rows_text is not None else None) for (d, _, _, t), (_, rows_text, *_) in zip(kept_text(left), left, strict=True)]
    left = clean(near_copies_kept(left), items)
    assert len(left) < len(rows) - 60
    got = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in corpus_pipeline.run(spark, at).collect())
    assert got == pieces(left)


def test_stages_keep_columns_and_take_anything(spark, folder, docs, rows, empty):
    at, _, items = folder
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, at)
        assert made.columns == docs.columns and 0 < made.count() <= len(rows)
        assert stage(spark, empty, at).count() == 0
        odd = docs.withColumnsRenamed({"row": "a.b", "h": "c`d e", "label": "component_id"})
        again = stage(spark, odd, at)
        assert again.columns == odd.columns and again.count() == made.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, at).count() == 0


def test_each_row_is_judged_where_ids_come_twice(spark, folder, docs, rows):
    """Repeated rows, two texts of one id and rows without ids: one of each group stays, and test items are found in all."""
    at, _, items = folder
    more = docs.unionByName(spark.createDataFrame([(None, items[2][1], None, None, None, 1), (9, "x " + items[3][1], None, None, None, 1)], docs.schema))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, more, at).collect()]
    assert Counter(kept) == Counter((r[0], r[1]) for r in rows)
    numbered = [(k, r[1]) for k, r in enumerate(rows)]
    groups = Counter(c for k, n, c in brute_components(numbered, 5, 80))
    got = corpus_pipeline.drop_near_copies(spark, docs, at)
    assert got.count() == len(groups)
    texts = Counter(r.text for r in got.collect())
    assert all(n == 1 for t, n in texts.items() if t and t.strip()) and texts[None] == sum(r[1] is None for r in rows)
    assert got.where(F.col("doc_id").isNull()).count() >= 1
