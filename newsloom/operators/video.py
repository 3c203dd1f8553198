"""JOIN-17, AGG-14, TOP-7/8: live streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import text as tx
from newsloom.operators.grouping import first_row, highest
from newsloom.session import computed, small_side


def channel_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def newsroom_table(spark, names=None) -> DataFrame:
    rows = [(n, n) for n in (names or dims.NEWSROOMS)]
    return spark.createDataFrame(rows, "newsroom_name string, alias string")


def match_newsrooms(streams: DataFrame, newsrooms: DataFrame) -> DataFrame:
    """JOIN-17: streams of a known newsroom, with newsroom_name."""
    keys = small_side(newsrooms.select(channel_key(F.col("alias")).alias("_k"), "newsroom_name").dropDuplicates(["_k"]))
    return streams.withColumn("_k", channel_key(F.col("channel_name"))).join(keys, "_k").drop("_k")


def best_stream_per_newsroom(streams: DataFrame, newsrooms: DataFrame, fallback: DataFrame, k: int = 12) -> DataFrame:
    """AGG-14: most watched stream per newsroom; the verified list when none is found."""
    cols = ["newsroom_name", "id", "title", "channel_name", "viewer_count"]
    best = first_row(match_newsrooms(streams, newsrooms).select(cols), ["newsroom_name"], [highest("viewer_count"), F.col("id")])
    some = best.limit(1).agg((F.count("*") > 0).alias("_some"))
    pool = best.withColumn("_f", F.lit(True)).unionByName(fallback.select(cols).withColumn("_f", F.lit(False)))
    return (
        pool.join(F.broadcast(some)).filter("_f = _some").drop("_f", "_some")
        .orderBy(F.desc("viewer_count"), "newsroom_name").limit(k)
    )


def rank_streams_for_headline(streams: DataFrame, headline: str, k: int = 8) -> DataFrame:
    """TOP-7: streams sharing enough headline words, most watched first."""
    wanted = tx.search_tokens(F.lit(headline))
    shared = F.size(F.array_intersect(tx.search_tokens(F.col("title")), wanted))
    needed = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(F.size(wanted) * 0.25).cast("int")))
    out = computed(streams, "*", shared.alias("relevance")).filter(F.col("relevance") >= needed)
    return out.orderBy(F.desc("viewer_count"), F.desc("relevance"), "id").limit(k)


def rank_city_cameras(streams: DataFrame, country: str, capital: str, newsrooms: DataFrame, k: int = 8) -> DataFrame:
    """TOP-8: city cameras of a place; broadcasts and newsrooms are left out."""
    described = F.col("coverage_description") if "coverage_description" in streams.columns else F.lit("")
    text = F.lower(F.concat_ws(" ", "title", "channel_name", F.coalesce(described, F.lit(""))))
    broadcast = rf"(?:^|[^A-Za-z0-9_])(?:{'|'.join(dims.BROADCAST_TERMS)})(?:[^A-Za-z0-9_]|$)"
    is_camera = F.exists(tx.lit_array(dims.CAMERA_TERMS), lambda t: F.col("_x").contains(t))
    keys = small_side(newsrooms.select(channel_key(F.col("alias")).alias("_k")).distinct())
    rows = (
        computed(streams, "*", text.alias("_x")).filter(is_camera & ~F.col("_x").rlike(broadcast))
        .withColumn("_k", channel_key(F.col("channel_name"))).join(keys, "_k", "left_anti")
    )
    rows = computed(rows, "*", tx.search_tokens(F.col("_x")).alias("_t"))
    matches = lambda s: F.size(F.array_intersect("_t", tx.search_tokens(F.lit(s))))
    rows = computed(rows, "*", (matches(capital) * 10 + matches(country)).alias("location_score")).filter("location_score > 0")
    one = first_row(rows.drop("_x", "_k", "_t"), ["id"], [highest("viewer_count"), F.col("title")])
    return one.orderBy(F.desc("location_score"), F.desc("viewer_count"), "title", "id").limit(k)
