"""Operator 7: benchmark decontamination by MinHash containment search, in DataFrame functions only.

A text's words are those between ASCII white space, in lower case; its set holds its
distinct shingles of five words, or the whole word sequence if there are fewer. A document
holds an item if at least ``share`` of the item's shingles are in the document's set.

Items are partitioned by the power of two of their set's size. The MinHash sketch of an
item of n shingles is its n - ceil(share * n) + 1 smallest hashes: a document that holds
the item can miss at most n - ceil(share * n) of its shingles, so it has one of the sketch.
No document however long is missed, then, and each item's sketch stays a fifth of its set.
Documents with fewer shingles than the smallest item of a partition needs are not searched
for that partition. Candidate pairs are verified on the shingles' texts.

Null and empty texts, of items too, have no shingles and match nothing; repeated rows, of
items too, each get their results, as do items with a null id, since items are known by a
hash of id and text until the end; an empty table on either side gives no pairs; other columns are not
read; texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

WORDS, SHARE = 5, 0.8
#: Rows up to which the sketch index (about 3 MB) and the candidates are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_words(df: DataFrame, text: str, name: str = "__words") -> DataFrame:
    """Adds the words as a column that no later expression can repeat the splitting of."""
    return df.withColumn(name, F.explode(F.array(words_of(F.col(f"`{text}`")))))


def _each(words: Column, size: int, make) -> Column:
    """make(list of word columns) for each run of ``size`` words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: make([F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs)


def shingle_texts(words: Column, size: int = WORDS) -> Column:
    short = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words)))
    return F.coalesce(_each(words, size, lambda w: F.concat_ws(" ", *w)), short)


def _need(n: Column, share: float) -> Column:
    return F.ceil(n * F.lit(share) - F.lit(1e-9))


def items_of(benchmark: DataFrame, item_id: str, text: str, size: int, share: float) -> DataFrame:
    words = with_words(benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("__text")), "__text")
    sets = words.where(F.size("__words") > 0).select("item_id", F.xxhash64("item_id", "__text").alias("item_key"), F.explode(F.array(F.array_distinct(shingle_texts(F.col("__words"), size)))).alias("item_shingles"))
    n = F.size("item_shingles")
    return sets.select("*", n.cast("long").alias("n_item"), _need(n, share).cast("long").alias("need"), F.floor(F.log2(n.cast("double"))).cast("int").alias("size_class"))


def candidates(docs: DataFrame, items: DataFrame, text: str, size: int) -> DataFrame:
    """(doc key, item keys): each pair with a hash of the item's sketch in the document."""
    hashes = F.array_sort(F.transform("item_shingles", lambda s: F.xxhash64(s)))
    sketch = items.select("item_key", "need", "size_class", F.explode(F.slice(hashes, 1, (F.col("n_item") - F.col("need") + 1).cast("int"))).alias("hash"))
    # One row for each power of two.
    least = items.groupBy("size_class").agg(F.min("need").alias("least"))
    sketch = sketch.join(F.broadcast(least), "size_class").select("item_key", "least", "hash")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    sets = with_words(docs, text).select("__doc", "__text_hash", F.greatest(F.size("__words") - size + 1, F.lit(1)).alias("__n"), shingle_texts(F.col("__words"), size).alias("__shingles"))
    found = sets.select("__doc", "__text_hash", "__n", F.explode("__shingles").alias("__shingle")).withColumn("hash", F.xxhash64("__shingle"))
    found = found.join(sketch, "hash").where(F.col("__n") >= F.col("least"))
    return found.groupBy("__doc", "__text_hash").agg(F.collect_set("item_key").alias("__items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment, and text_hash that tells rows of one id apart."""
    items = items_of(benchmark, item_id, item_text, size, share)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__text_hash"), F.col(f"`{text}`").alias("__text"))
    pairs = checkpointed(candidates(keyed.withColumnRenamed("__text", "text"), items, "text", size))
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    near = keyed.alias("d").join(pairs.alias("p"), F.col("d.__text_hash").eqNullSafe(F.col("p.__text_hash")) & F.col("d.__doc").eqNullSafe(F.col("p.__doc")))
    near = with_words(near.select("d.__doc", "d.__text_hash", "p.__items", "d.__text"), "__text").select("__doc", "__text_hash", "__items", F.array_distinct(shingle_texts(F.col("__words"), size)).alias("__set"))
    near = near.select("__doc", "__text_hash", "__set", F.explode("__items").alias("item_key"))
    found = near.join(items, "item_key").select(
        F.col("__doc").alias("doc_id"), "item_id", "n_item", "need", F.size(F.array_intersect("item_shingles", "__set")).cast("long").alias("n_found"), F.col("__text_hash").alias("text_hash")
    )
    return found.where(F.col("n_found") >= F.col("need")).select("doc_id", "item_id", "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment"), "text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = contamination(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__hash")), "left_anti")
