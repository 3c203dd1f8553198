"""STREAM-1..6: landed feeds as streams and last-known-good country state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.feeds import article_key, collection_progress
from newsloom.operators.quality import MAX_AGE, MAX_AHEAD, filter_current, filter_english
from newsloom.session import ts
from newsloom.sources import feeds
from newsloom.streaming.state import CountryState

REFRESH = "5 minutes"


def stream_articles(spark: SparkSession, path: str, as_of: Column | str | None = None, fmt: str = "rss", flavour: str = "publisher", files_per_trigger: int = 1000, **source) -> DataFrame:
    """STREAM-1/4: a landing folder as a stream of current English articles."""
    if fmt == "rss":
        rows = feeds.read_rss_articles(spark, path, flavour, stream=files_per_trigger, **source)
    elif fmt == "json":
        rows = feeds.read_article_json(spark, path, stream=files_per_trigger)
    else:
        raise ValueError("fmt must be rss or json")
    at = ts(as_of) if as_of is not None else F.current_timestamp()
    return filter_english(filter_current(rows, at))


def with_dropped(rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """STREAM-4: current rows, and those dropped by date with the ``reason`` (missing, late or future)."""
    at, when = ts(as_of), F.col("published_at")
    reason = F.when(when.isNull(), "missing").when(when < at - F.expr("INTERVAL 8 DAYS"), "late").when(when > at + F.expr("INTERVAL 6 HOURS"), "future")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def stream_dedupe(stream: DataFrame, keys: list[str] = ("country_name", "article_key"), delay: str = "8 days") -> DataFrame:
    """STREAM-2: first arrival per key while it can still be current.

    Future-dated rows must be dropped before (STREAM-4), or they would move the watermark.
    """
    df = stream if "article_key" in stream.columns else stream.withColumn("article_key", article_key())
    return df.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(list(keys))


def last_known_good(root: str, schema: str, as_of: Callable[[DataFrame, int], object], gazetteer: DataFrame | None = None, rules: DataFrame | None = None, longest: int | None = None, **state):
    """STREAM-3: a ``foreachBatch`` function folding a batch into the keyed state (``CountryState``).

    An empty batch erases nothing; stories leave only by age. A batch writes its own rows and the next version, so a
    lost executor or a retried batch never leaves half a state; a batch that is folded twice changes nothing.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        CountryState(batch.sparkSession, root, schema, **state).upsert(batch, as_of(batch, batch_id), gazetteer, rules, longest)

    return fold


def refresh(stream: DataFrame, fold, checkpoint: str, once: bool = False, every: str = REFRESH):
    """STREAM-5: start the query, every five minutes or once over what has landed."""
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def publish_when_ready(directory: DataFrame, attempts: DataFrame, articles: DataFrame, global_articles: DataFrame, publish: Callable[[], None]) -> bool:
    """STREAM-6: publish only after every country was attempted and global news exists; until then output is withheld."""
    ready = bool(collection_progress(directory, attempts, articles, global_articles).first()["ready"])
    if ready:
        publish()
    return ready
