"""FLT-1..5: normalizing landed rows and dropping those that are not current reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.session import computed, ts

MAX_AGE = "INTERVAL 8 DAYS"
MAX_AHEAD = "INTERVAL 6 HOURS"
ARTICLE_COLUMNS = [
    "id", "title", "description", "image_url", "url", "publisher_name", "publisher_url",
    "published_at", "searchable_text",
]


def _remove_literal(c: Column, needle: Column) -> Column:
    """Case-insensitive removal of a literal that differs per row."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(needle, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    return F.when(needle == "", c).otherwise(F.regexp_replace(c, quoted, F.lit(" ")))


def normalize_articles(raw: DataFrame, description_chars: int | None = None) -> DataFrame:
    """FLT-1: raw feed strings to article rows; unusable rows are dropped.

    Input: title, url, publisher_name, publisher_url, published (string or timestamp),
    description, guid, image_url. Other columns pass through. ``description_chars`` cuts the
    displayed description only; ``searchable_text`` always holds all of it.
    """
    cols = set(raw.columns)
    get = lambda n: F.col(n) if n in cols else F.lit(None).cast("string")
    published = (
        F.col("published")
        if dict(raw.dtypes).get("published") == "timestamp"
        else tx.parse_date(get("published"))
    )
    extra = [c for c in raw.columns if c not in {"title", "url", "publisher_name", "publisher_url", "published", "description", "guid", "image_url", "id"}]
    df = computed(
        raw,
        tx.strip_markup(get("title")).alias("title"),
        tx.strip_markup(get("description")).alias("description"),
        tx.safe_url(tx.decode_entities(get("image_url"))).alias("image_url"),
        tx.safe_url(tx.decode_entities(get("url"))).alias("url"),
        tx.strip_markup(get("publisher_name")).alias("_stated"),
        tx.safe_url(tx.decode_entities(get("publisher_url"))).alias("_publisher_url"),
        published.alias("published_at"),
        get("guid").alias("_guid"),
        *extra,
    )
    stated = (F.col("_stated") != "") & (F.lower("_stated") != "independent publisher")
    df = df.withColumn(
        "publisher_name", F.when(stated, F.col("_stated")).otherwise(tx.publisher_from_url(F.col("url")))
    )
    df = df.filter(
        (F.col("title") != "")
        & ~tx.is_non_event_title(F.col("title"))
        & F.col("url").isNotNull()
        & (F.coalesce("publisher_name", F.lit("")) != "")
        & F.col("published_at").isNotNull()
    )
    shown = F.col("description") if description_chars is None else F.substring("description", 1, description_chars)
    return df.select(
        tx.stable_id(F.coalesce(F.nullif(F.col("_guid"), F.lit("")), F.col("url"))).alias("id"),
        "title",
        F.nullif(shown, F.lit("")).alias("description"),
        "image_url",
        "url",
        "publisher_name",
        F.coalesce("_publisher_url", tx.url_origin(F.col("url"))).alias("publisher_url"),
        "published_at",
        F.trim(F.concat_ws(" ", "title", _remove_literal(F.col("description"), F.col("publisher_name")))).alias("searchable_text"),
        *extra,
    )


def filter_current(df: DataFrame, as_of, column: str = "published_at") -> DataFrame:
    """FLT-2 / STREAM-4: at most 8 days old, at most 6 hours ahead, no error pages."""
    at = ts(as_of)
    out = df.filter(F.col(column).between(at - F.expr(MAX_AGE), at + F.expr(MAX_AHEAD)))
    return out.filter(~tx.is_error_title(F.col("title"))) if "title" in df.columns else out


def filter_event_titles(df: DataFrame) -> DataFrame:
    """FLT-3."""
    return df.filter(~tx.is_non_event_title(F.col("title")))


def filter_english(df: DataFrame) -> DataFrame:
    """FLT-4."""
    return df.filter(tx.is_english(F.col("title")))


def gate_feeds(feeds: DataFrame, articles: DataFrame, as_of, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT-5: empty feeds fail, and those above ``max_chars`` if one is given; the others keep their current articles.

    ``feeds(feed_name, body_chars)`` lists every feed of the run, one row each. Returns
    (surviving articles, feed_status(feed_name, status, article_count)).
    """
    current = filter_current(articles, as_of)
    counts = current.groupBy("feed_name").agg(F.count("*").alias("n"))
    ok = F.coalesce("n", F.lit(0)) > 0
    if max_chars is not None:
        ok = ok & (F.coalesce("body_chars", F.lit(0)) <= max_chars)
    status = feeds.join(counts, "feed_name", "left").select(
        "feed_name",
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(ok, F.col("n")).otherwise(0).cast("long").alias("article_count"),
    )
    return current.join(status.filter("status = 'ok'").select("feed_name"), "feed_name", "left_semi"), status


def feed_health(status: DataFrame) -> DataFrame:
    """AGG-7: totals and the degraded flag over feed_status rows."""
    good = F.col("status") == "ok"
    return status.agg(
        F.count("*").alias("feeds"),
        F.count_if(good).alias("ok_feeds"),
        F.coalesce(F.sum("article_count"), F.lit(0)).cast("long").alias("article_count"),
        (F.count_if(good) < F.count("*")).alias("degraded"),
    )
