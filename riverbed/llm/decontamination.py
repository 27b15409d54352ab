"""Benchmark decontamination: containment search by size-partitioned MinHash sketches, then exact containment.

DataFrame functions only. Items are partitioned by their number of shingles, in powers of two. An item's sketch holds
its smallest shingle hashes, as many as the largest size of its partition asks for: an item of n shingles of which a
document holds a share t lacks at most n - ceil(t n) of them, so of the n - ceil(t n) + 1 smallest hashes at least one
is in the document. The sketch thus loses no item, however long the document is, and keeps about a share 1 - t of the
shingles. An item below its partition's largest size has a longer sketch than it needs and must be hit the more often.
Pairs that the search finds, and no others, are verified on the whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.llm.common import BLANKS, materialize

#: Rows of a sketch or of ids up to which they are broadcast: some 25 bytes each.
BROADCAST_ROWS = 200_000
#: Items that a document is verified against at once; their number decides how often its words are read.
ITEMS_AT_ONCE = 256


def _words(df: DataFrame, *keep) -> DataFrame:
    text = F.btrim(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return df.select(*keep, F.split(text, BLANKS).alias("w")).where("w[0] <> ''")


def _hash(words: list) -> Column:
    """Hash of a run of words; nulls behind its end don't count."""
    return F.xxhash64(*words)


def _shingles(m: Column) -> Column:
    """The distinct runs of ``m`` words of ``w``, as texts."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.array_join(F.slice("w", i + 1, m), " ")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for each item of which a document holds ``percent`` of the shingles or more.

    Shingles are runs of ``n`` words of the lower-cased text; an item of fewer words is one shingle as a whole. Rows of
    ``docs`` with one ``doc_id`` count as one document, and rows of ``items`` with one ``item_id`` and different texts as
    several forms of it: the form with the most shared shingles is returned. Null or blank texts and null ids match
    nothing. Empty tables give no rows; columns other than the id and ``text`` are ignored.
    """
    docs = docs.select(F.col("doc_id"), F.col("text")).where("doc_id is not null")
    words = _words(items.where("item_id is not null"), "item_id", F.xxhash64("text").alias("form")).dropDuplicates(["item_id", "form"])
    sets = words.withColumn("m", F.least(F.size("w"), F.lit(n))).select("item_id", "form", "m", _shingles(F.col("m")).alias("shingles"))
    sets = sets.withColumn("n_item", F.size("shingles").cast("long")).withColumn("part", F.floor(F.log2("n_item")))
    sets = materialize(sets, "items")
    share = lambda x: F.ceil(x * percent / F.lit(100))
    tops = sets.groupBy("part").agg(F.max("n_item").alias("most"))  # one row for each power of two
    hashes = F.array_sort(F.array_distinct(F.transform("shingles", lambda x: _hash([F.get(F.split(x, " "), F.lit(k)) for k in range(n)]))))
    sketch = sets.join(F.broadcast(tops), "part").withColumn("sketch", F.slice(hashes, 1, (F.col("most") - share(F.col("most")) + 1).cast("int")))
    least = F.size("sketch") - (F.col("n_item") - share(F.col("n_item")))
    sketch = materialize(sketch.select("item_id", "form", "m", least.alias("least"), F.explode("sketch").alias("h")), "sketch")

    lengths = sorted(r["m"] for r in sets.select("m").distinct().collect())  # n of them at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", item_id long, n_item long, n_shared long")
    doc_words = _words(docs, "doc_id")
    places = doc_words.where(F.size("w") >= lengths[0]).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("i"))
    run = lambda m: _hash([F.get("w", F.col("i") + k) if k < m else F.lit(None).cast("string") for k in range(n)])
    if len(lengths) == 1:
        runs = places.select("doc_id", F.lit(lengths[0]).alias("m"), run(lengths[0]).alias("h"))
    else:  # all lengths from one reading
        each = F.array(*[F.struct(F.lit(m).alias("m"), F.when(F.col("i") + m <= F.size("w"), run(m)).alias("h")) for m in lengths])
        runs = places.select("doc_id", F.inline(each)).where("h is not null")
    hits = runs.join(_small(sketch, sketch.count()), ["m", "h"]).select("doc_id", "item_id", "form", "m", "least", "h").distinct()
    candidates = hits.groupBy("doc_id", "item_id", "form", "m").agg(F.count("*").alias("k"), F.max("least").alias("least")).where("k >= least")
    candidates = materialize(candidates.drop("k", "least"), "candidates")

    place = F.row_number().over(Window.partitionBy("doc_id", "m").orderBy("item_id", "form")) - 1
    listed = candidates.withColumn("chunk", F.floor(place / ITEMS_AT_ONCE)).join(sets.drop("m", "part"), ["item_id", "form"])
    listed = listed.groupBy("doc_id", "m", "chunk").agg(F.collect_list(F.struct("item_id", "form", "n_item", "shingles")).alias("items"))
    ids = _small(candidates.select("doc_id").distinct(), candidates.count())
    again = _words(docs.join(ids, "doc_id", "left_semi"), "doc_id")  # these are few; their items' shingles aren't broadcast
    pairs = again.join(listed, "doc_id").where(F.size("w") >= F.col("m")).withColumn("own", _shingles(F.col("m")))
    met = F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["form"].alias("form"), x["n_item"].alias("n_item"), F.array_intersect(x["shingles"], F.col("own")).alias("both")))
    shared = pairs.select("doc_id", F.inline(met)).select("doc_id", "item_id", "form", "n_item", F.explode("both").alias("shingle")).distinct()
    counts = shared.groupBy("doc_id", "item_id", "form").agg(F.max("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    counts = counts.where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    best = F.max_by(F.struct("n_item", "n_shared"), F.struct("n_shared", "n_item"))
    return counts.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_item").alias("n_item"), F.col("b.n_shared").alias("n_shared"))
