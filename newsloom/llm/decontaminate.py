"""Benchmark items inside documents: size-partitioned MinHash containment search, exact check.

Everything is DataFrame functions. Words are runs of letters and digits, lower case; shingles have five words. An
item of fewer words is one shingle of its own length, and documents have shingles of each such length that occurs
among the items, so a short item is found wherever its words stand in a row.

1. Items are partitioned by their shingle length and their number of shingles (powers of two). An item's sketch are its smallest shingle
   hashes, as many as it could miss and still be contained, plus one: ``n - ceil(threshold * n) + 1``. At least
   one of them is in every document that contains the item, so no item is missed.
2. A partition's largest sketch hash bounds what its search must see of a document: the MinHash threshold of the
   partition. Of a document's shingles, however long it is, only those below the widest threshold are compared, and
   each only with sketches of partitions whose threshold it is below. The widest threshold is one for each length.
3. Documents that share a sketch hash are candidates with that item. For them the containment is computed on the
   full sets: |item and document| / |item|.

Shingles are known by 64-bit hashes. Defined cases: null, empty or wordless texts and items match nothing; rows
that repeat a doc_id or item_id give one row per pair, with the largest containment; null ids are kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch, fresh

SIZE = 5
PERCENT = 80


def with_words(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``h``, the word hashes of column text in order; rows without words go."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", " ")), " ", -1)
    return df.select(*keep, F.transform(words, lambda w: F.when(w != "", F.xxhash64(w))).alias("h")).where("h is not null and h[0] is not null")


def shingles(length: int) -> Column:
    """The hashes of all shingles of ``length`` words of column h; none if it has fewer words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - length, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.lit(length), *(F.get("h", i + k) for k in range(length))))
    return F.when(F.size("h") >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def find(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of all pairs with containment of ``percent`` or more."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    own = F.coalesce(*(F.when(F.size("h") == k, shingles(k)) for k in range(1, SIZE)), shingles(SIZE))
    known = with_words(items, ["item_id"]).select("item_id", F.least(F.size("h"), F.lit(SIZE)).alias("length"), F.array_sort(F.array_distinct(own)).alias("item"))
    known = known.groupBy("item_id", "length", "item").agg(F.count(F.lit(1)).alias("rows")).drop("rows").withColumn("n_item", F.size("item").cast("long"))
    known = scratch.table(known.withColumn("item_row", F.xxhash64("item_id", F.array_join(F.transform("item", lambda x: x.cast("string")), " "))), "items")
    missed = F.expr(f"cast(n_item - ceil(n_item * {percent} / 100.0) + 1 as int)")
    sketches = known.select("item_row", "length", F.floor(F.log2("n_item")).alias("size_class"), F.explode(F.slice("item", F.lit(1), missed)).alias("hash"))
    bounds = sketches.groupBy("length", "size_class").agg(F.max("hash").alias("bound"))
    sketches = scratch.table(sketches.join(bounds, ["length", "size_class"]), "sketches")
    widest = {r.length: r.bound for r in sketches.groupBy("length").agg(F.max("bound").alias("bound")).collect()}  # at most SIZE rows
    none = F.array().cast("array<bigint>")
    every = F.concat(none, *(shingles(k) for k in sorted(widest)))
    below = lambda bound: lambda x: x <= F.lit(bound)
    low = [F.filter(shingles(k), below(widest[k])) for k in sorted(widest)]
    seen = with_words(docs, ["doc_id"]).select("doc_id", F.explode(F.concat(none, *low)).alias("hash"))
    candidates = scratch.table(
        seen.join(scratch.small(sketches), "hash").where("hash <= bound").select("doc_id", "item_row").distinct(), "candidates"
    )
    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    ids = F.broadcast(ids) if scratch.bytes(candidates) <= 4 << 20 else ids
    texts = with_words(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), ["doc_id"]).select("doc_id", F.array_distinct(every).alias("shingles"))
    pairs = texts.join(candidates.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).join(scratch.small(known), "item_row")
    shared = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", "item")).cast("long")).where(f"100 * n_shared >= {percent} * n_item")
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", F.col("best.c").alias("containment"))


def remove(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose own text contains no item; rows are known by their text, so ids may repeat or be null."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    own = F.md5(F.col("text").cast("string").cast("binary"))
    texts = docs.select(own.alias("doc_id"), "text")
    name = fresh(docs, "found")
    found = scratch.table(find(texts, items, percent).select(F.col("doc_id").alias(name)).distinct(), "found")
    return docs.join(scratch.small(found), own == F.col(name), "left_anti")


# Containment on shingle texts, for DuckDB: an item of k words below five has one shingle of k words, met in the k-word runs of every text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
     i AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
     l AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
     ds AS (SELECT DISTINCT id, k, s FROM (SELECT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM d, l WHERE len(w) >= k)),
     si AS (SELECT DISTINCT id, k, s FROM (SELECT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM (SELECT id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0))),
     n AS (SELECT id, count(*) AS n_item FROM si GROUP BY id)
SELECT ds.id AS doc_id, si.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM ds JOIN si USING (k, s) JOIN n ON n.id = si.id GROUP BY ds.id, si.id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
