"""JOIN-5/6, RANK-1/3, AGG-3: publisher ratings, prominence and perspective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import text as tx
from newsloom.operators.grouping import first_row, highest, newest, top_rows
from newsloom.session import small_side

BUCKETS = ["left", "center", "right", "unrated"]


def join_publisher_rating(df: DataFrame, ratings: DataFrame, name: str = "publisher_name") -> DataFrame:
    """JOIN-5: adds publisher_key, bucket, rating_label; no match means unrated."""
    r = ratings.select("publisher_key", F.col("bucket"), F.col("label").alias("rating_label"))
    return df.withColumn("publisher_key", tx.publisher_key(F.col(name))).join(
        small_side(r.dropDuplicates(["publisher_key"])), "publisher_key", "left"
    )


def prominence_of(key: Column, rows=None) -> Column:
    """JOIN-6 as an expression: the first needle contained in the key decides."""
    rows = sorted(rows or dims.PROMINENCE)
    table = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(s).alias("score")) for _, n, s in rows])
    found = F.filter(table, lambda p: key.contains(p["needle"]))
    return F.coalesce(F.try_element_at(found, F.lit(1))["score"], F.lit(dims.DEFAULT_PROMINENCE))


def join_publisher_prominence(df: DataFrame, prominence: DataFrame, name: str = "publisher_name") -> DataFrame:
    """JOIN-6 against a table: distinct publishers meet the needles once, then join back."""
    df = df.withColumn("publisher_key", tx.publisher_key(F.col(name)))
    keys = df.select("publisher_key").distinct()
    scored = keys.join(small_side(prominence), F.col("publisher_key").contains(F.col("needle")), "left").groupBy(
        "publisher_key"
    ).agg(F.coalesce(F.min_by("score", "ord"), F.lit(dims.DEFAULT_PROMINENCE)).alias("prominence"))
    return df.join(scored, "publisher_key")


def latest_article_per_publisher(df: DataFrame, keys: list[str]) -> DataFrame:
    """RANK-1: newest article per (keys, publisher_key)."""
    return first_row(df, [*keys, "publisher_key"], [newest("published_at"), F.col("id")])


def balanced_top_sources(
    df: DataFrame, keys: list[str], limit: int = 5, balance: Column | None = None
) -> DataFrame:
    """RANK-3: top sources per key with publisher viewpoints represented.

    Needs prominence, bucket (null = unrated), published_at, publisher_key, id. Where ``balance`` is
    true the best left and best right source come first, then centre ones, then the
    rest; the chosen rows get ``rank`` by prominence and recency.
    """
    order = [highest("prominence"), newest("published_at"), F.col("publisher_key"), F.col("id")]
    # Only the first `limit` of each bucket can be chosen, so prune before the full ranking.
    df = top_rows(df.withColumn("_b", F.coalesce("bucket", F.lit("unrated"))), [*keys, "_b"], order, limit, "_in_bucket")
    first_of_side = F.col("_b").isin("left", "right") & (F.col("_in_bucket") == 1)
    tier = F.when(first_of_side, 0).when(F.col("_b") == "center", 1).otherwise(2)
    df = df.withColumn("_tier", F.when(balance if balance is not None else F.lit(True), tier).otherwise(0))
    chosen = top_rows(df, keys, [F.col("_tier"), *order], limit, "_chosen")
    w = Window.partitionBy(*keys).orderBy(*order)
    return chosen.withColumn("rank", F.row_number().over(w)).drop("_b", "_in_bucket", "_tier", "_chosen")


def shows_perspective(category: Column) -> Column:
    return category.isin(dims.PERSPECTIVE_CATEGORIES)


def publisher_perspective_mix(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-3: distinct publishers per bucket and percentages that add up to 100.

    Input has publisher_key and bucket; the rest after flooring goes to the largest
    fractions, ties in the order left, center, right, unrated.
    """
    one = df.select(*keys, "publisher_key", F.coalesce("bucket", F.lit("unrated")).alias("bucket"))
    one = one.groupBy(*keys, "publisher_key").agg(F.min("bucket").alias("bucket"))
    counts = one.groupBy(*keys).agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.count("*").alias("total")
    )
    value = {b: F.col(b) / F.col("total") * 100.0 for b in BUCKETS}
    floor = {b: F.floor(value[b]) for b in BUCKETS}
    fraction = {b: value[b] - F.floor(value[b]) for b in BUCKETS}
    left_over = F.lit(100) - sum(floor.values(), F.lit(0))

    def place(b: str) -> Column:
        ahead = [
            F.when((fraction[o] > fraction[b]) | ((fraction[o] == fraction[b]) & F.lit(BUCKETS.index(o) < BUCKETS.index(b))), 1).otherwise(0)
            for o in BUCKETS
            if o != b
        ]
        return sum(ahead, F.lit(0))

    return counts.select(
        *keys, *BUCKETS, (F.col("total") - F.col("unrated")).alias("rated"), "total",
        *[(floor[b] + F.when(place(b) < left_over, 1).otherwise(0)).cast("int").alias(f"{b}_pct") for b in BUCKETS],
    )
