"""DEDUP-1, RANK-4: order-dependent deduplication on two keys at once.

Scanning in rank order and dropping a row when its URL key *or* its title key belongs
to an already kept row keeps the lexicographically first maximal independent set. It is
computed in rounds: a row that is the first undecided one of both its groups is kept;
undecided rows that share a key with a kept row are dropped. Group minima combine
map-side and exact (URL, title) copies collapse first, so a hot key costs one row per
task. The rounds run on (rank, keys) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.grouping import newest, sliced_row_number
from newsloom.operators.quality import filter_english
from newsloom.session import cut


def keep_first(df: DataFrame, rank: list[Column], key_a: Column, key_b: Column) -> DataFrame:
    """Rows kept by the scan; ``rank`` must be a unique total order."""
    rank_cols = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    slim = df.select(rank_cols.alias("r"), key_a.alias("a"), key_b.alias("b"))
    open_rows = cut(slim.groupBy("a", "b").agg(F.min("r").alias("r")))
    kept = None
    while True:
        first_a = open_rows.groupBy("a").agg(F.min_by("b", "r").alias("b"), F.min("r").alias("r"))
        first_b = open_rows.groupBy("b").agg(F.min("r").alias("r"))
        won = cut(first_a.join(first_b, ["b", "r"]).select("a", "b", "r"))
        kept = won if kept is None else kept.unionByName(won)
        open_rows = cut(
            open_rows.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti")
        )
        if open_rows.isEmpty():
            break
    return df.withColumn("_r", rank_cols).join(kept.select(F.col("r").alias("_r")), "_r", "left_semi").drop("_r")


def dedupe_articles(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """DEDUP-1: English headlines, newest first, first per URL key or title key."""
    kept = keep_first(
        filter_english(articles),
        [newest("published_at"), F.col("id")],
        tx.url_key(F.col("url"), F.col("title")),
        tx.title_key(F.col("title")),
    )
    return kept.orderBy(newest("published_at"), "id").limit(limit) if limit else kept


def interleave_feeds(articles: DataFrame, limit: int | None = None, slice_rows: int = 4096) -> DataFrame:
    """RANK-4: round-robin over feeds by position, then the same filters in that order.

    Input columns feed_ord and feed_pos give the order of feeds and inside each feed.
    Depth counts every article of the feed, also those filtered later.
    """
    ranked = sliced_row_number(
        articles, ["feed_ord"], F.floor(F.col("feed_pos") / slice_rows), [F.col("feed_pos"), F.col("id")], "depth"
    )
    kept = keep_first(
        filter_english(ranked),
        [F.col("depth"), F.col("feed_ord")],
        tx.url_key(F.col("url"), F.col("title")),
        tx.title_key(F.col("title")),
    )
    return kept.orderBy("depth", "feed_ord").limit(limit) if limit else kept
