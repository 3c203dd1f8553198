"""Country feeds: merging scans, diversity, completeness and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import scoring, text as tx
from newsloom.operators.countries import filter_relevant_to_country
from newsloom.operators.grouping import complete_pages, first_row, highest, newest, paged, sliced_row_number, top_rows
from newsloom.operators.quality import filter_current, filter_event_titles
from newsloom.session import ts

COUNTRY_ARTICLES = 20
SOURCE_DEPTH = 5


def article_key() -> Column:
    return F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.col("title"))


def merge_country_feed(incoming: DataFrame, current: DataFrame, as_of, gazetteer: DataFrame | None = None, rules: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """DEDUP-2 without the diversity cap: valid articles, incoming preferred per key.

    Both sides: article rows with country_name. One hot country is spread by article key.
    """
    both = incoming.withColumn("side", F.lit(0)).unionByName(current.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = filter_event_titles(filter_current(both, as_of))
    if gazetteer is not None:
        both = filter_relevant_to_country(both.withColumn("broad_feed", F.lit(False)), gazetteer, rules, longest).drop("broad_feed")
    both = both.withColumn("article_key", article_key())
    return first_row(both, ["country_name", "article_key"], [F.col("side"), newest("published_at"), F.col("id")])


def country_feed_header(incoming_runs: DataFrame, current_runs: DataFrame, articles: DataFrame) -> DataFrame:
    """country_name, generated_at (incoming, else current), available."""
    head = incoming_runs.select("country_name", F.col("generated_at").alias("gi")).join(
        current_runs.select("country_name", F.col("generated_at").alias("gc")), "country_name", "full"
    )
    has = articles.select("country_name").distinct().withColumn("available", F.lit(True))
    return head.join(has, "country_name", "left").select(
        "country_name", F.coalesce("gi", "gc").alias("generated_at"), F.coalesce("available", F.lit(False)).alias("available")
    )


def diverse_articles(articles: DataFrame, events: DataFrame, limit: int = COUNTRY_ARTICLES) -> DataFrame:
    """RANK-5: at most ``limit`` per country, one source per event before second sources.

    ``events`` hold country_name, importance_score, last_updated_at, articles (newest
    first). Countries with no more than ``limit`` articles keep all of them.
    """
    keyed = articles if "article_key" in articles.columns else articles.withColumn("article_key", article_key())
    counts = keyed.groupBy("country_name").agg(F.count("*").alias("_n"))
    small = keyed.join(counts.filter(F.col("_n") <= limit).select("country_name"), "country_name", "left_semi")
    big = counts.filter(F.col("_n") > limit).select("country_name")
    order = [F.col("depth"), highest("event.importance_score"), newest("event.last_updated_at"), F.col("event.cluster_id")]
    rank = ["importance_score", "last_updated_at", "cluster_id"]
    picks = events.join(big, "country_name", "left_semi").select(
        "country_name", *rank, F.posexplode(F.slice("articles", 1, SOURCE_DEPTH)).alias("depth", "a")
    ).select("country_name", "depth", F.struct(*rank).alias("event"), F.col("a.id").alias("id"))
    chosen = picks.join(keyed, ["country_name", "id"])
    chosen = first_row(chosen, ["country_name", "article_key"], order)
    chosen = top_rows(chosen, ["country_name"], order, limit, "pos").drop("depth", "event")
    w = Window.partitionBy("country_name").orderBy(newest("published_at"), "id")
    return small.withColumn("pos", F.row_number().over(w)).unionByName(chosen.select(*small.columns, "pos"))


def top_event_per_country(directory: DataFrame, bridge: DataFrame, events: DataFrame, key: str = "country_code") -> DataFrame:
    """RANK-6: every country with its strongest, then latest, active event or null.

    ``bridge(event_id, <key>)``; the winner is an aggregate, not a sort of the group.
    """
    active = events.filter("active") if "active" in events.columns else events
    cols = ["event_id", "headline", "category", "importance_score", "importance_label", "last_updated_at"]
    linked = bridge.join(active.select(*cols), "event_id")
    best = first_row(linked, [key], [highest("importance_score"), newest("last_updated_at"), F.col("event_id")])
    return directory.join(best, key, "left")


def latest_events_per_country(events: DataFrame, k: int | None = 20) -> DataFrame:
    """RANK-7; all events with ``k`` None."""
    return top_rows(events, ["country_name"], [newest("last_updated_at"), highest("importance_score"), F.col("event_id")], k, "pos")


def complete_country_feeds(directory: DataFrame, events: DataFrame, generated_at, feeds: DataFrame | None = None) -> DataFrame:
    """JOIN-12: one row per directory country with all its ranked events; ``complete_country_pages`` bounds the rows."""
    order = F.struct(highest("importance_score").alias("s"), newest("last_updated_at").alias("t"), F.col("event_id").alias("i"))
    item = F.struct("event_id", "headline", "category", "importance_score", "last_updated_at")
    lists = events.groupBy("country_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("e")))), lambda p: p["e"]).alias("events")
    )
    empty = F.array().cast(lists.schema["events"].dataType)
    out = directory.join(lists, "country_name", "left").withColumn("events", F.coalesce("events", empty))
    if feeds is not None:
        out = out.join(feeds.select("country_name", "updated_at"), "country_name", "left")
    else:
        out = out.withColumn("updated_at", F.lit(None).cast("timestamp"))
    return out.withColumn("updated_at", F.coalesce("updated_at", ts(generated_at)))


PAGE_ROWS = 200


def complete_country_pages(directory: DataFrame, events: DataFrame, generated_at, feeds: DataFrame | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """JOIN-12 in pages: every directory country with its ranked events, at most ``page_rows`` a row; nothing is cut off."""
    order = [highest("importance_score"), newest("last_updated_at"), F.col("event_id")]
    part = F.struct(F.floor(F.coalesce(-F.col("importance_score"), F.lit(1e9))).alias("s"), F.floor(newest("last_updated_at") / 3_600_000_000).alias("h"))
    item = F.struct("event_id", "headline", "category", "importance_score", "last_updated_at")
    out = complete_pages(directory, paged(events, ["country_name"], part, order, item, page_rows), ["country_name"])
    if feeds is not None:
        out = out.join(feeds.select("country_name", "updated_at"), "country_name", "left")
    else:
        out = out.withColumn("updated_at", F.lit(None).cast("timestamp"))
    return out.withColumn("updated_at", F.coalesce("updated_at", ts(generated_at)))


def attach_global_events(events: DataFrame, directory: DataFrame) -> DataFrame:
    """JOIN-13: (country_name, event columns) for each affected country, by ISO-2 or name."""
    ids = directory.select("country_name", F.explode(F.array_distinct(F.array_compact(F.array("iso2", "country_name")))).alias("identifier"))
    exploded = events.withColumn("identifier", F.explode("affected_countries"))
    return exploded.join(F.broadcast(ids), "identifier").drop("identifier")


# --- monitoring -----------------------------------------------------------------------
def missing_coverage(directory: DataFrame, articles: DataFrame, expected_empty=tuple(dims.EXPECTED_EMPTY_COUNTRIES)) -> DataFrame:
    """JOIN-16: inhabited directory countries without any article."""
    inhabited = directory.filter(~F.col("country_name").isin(*expected_empty)) if expected_empty else directory
    return inhabited.join(articles.select("country_name").distinct(), "country_name", "left_anti")


def collection_progress(directory: DataFrame, attempts: DataFrame, articles: DataFrame, global_articles: DataFrame) -> DataFrame:
    """AGG-8: one row of counts and the readiness flag."""
    tried = attempts.filter("last_attempt_at is not null").select("country_name").distinct().withColumn("t", F.lit(1))
    news = articles.select("country_name").distinct().withColumn("n", F.lit(1))
    counts = directory.select("country_name").join(tried, "country_name", "left").join(news, "country_name", "left").agg(
        F.count("t").alias("attempted_countries"), F.count("n").alias("countries_with_news"), F.count("*").alias("total_countries")
    )
    glob = global_articles.limit(1).agg((F.count("*") > 0).alias("has_global"))
    return counts.join(F.broadcast(glob)).select(
        "attempted_countries", "countries_with_news", "total_countries",
        (F.col("has_global") & (F.col("attempted_countries") == F.col("total_countries"))).alias("ready"),
    )


def coverage_diagnostics(directory: DataFrame, attempts: DataFrame, articles: DataFrame, global_articles: DataFrame, expected_empty=tuple(dims.EXPECTED_EMPTY_COUNTRIES)) -> DataFrame:
    """AGG-9: one health row; the lists are bounded by the country directory."""
    progress = collection_progress(directory, attempts, articles, global_articles)
    missing = missing_coverage(directory, articles, expected_empty).agg(
        F.sort_array(F.collect_list("country_name")).alias("missing_inhabited_countries")
    )
    expected = directory.filter(F.col("country_name").isin(*expected_empty)).agg(
        F.sort_array(F.collect_list("country_name")).alias("expected_empty_countries")
    )
    n_global = global_articles.agg(F.count("*").alias("global_event_count"))
    healthy = F.col("ready") & (F.size("missing_inhabited_countries") == 0)
    return progress.join(F.broadcast(missing)).join(F.broadcast(expected)).join(F.broadcast(n_global)).withColumn(
        "inhabited_countries", F.col("total_countries") - F.size("expected_empty_countries")
    ).withColumn("status", F.when(healthy, "healthy").otherwise("degraded"))


def richer_of_two_runs(runs: DataFrame, threshold: int = 8) -> DataFrame:
    """AGG-15: per (country_name, feed_name) the run to use.

    ``runs(country_name, feed_name, run_no, article_count)``; run 1 is the first pull.
    A second run counts only where the first one of the country was thin, and replaces a
    feed only with strictly more articles; feeds seen only in the retry are appended.
    """
    first = runs.filter("run_no = 1").groupBy("country_name").agg(F.sum("article_count").alias("_total"))
    thin = runs.join(first, "country_name", "left").filter((F.col("run_no") == 1) | (F.coalesce("_total", F.lit(0)) < threshold))
    return first_row(thin.drop("_total"), ["country_name", "feed_name"], [highest("article_count"), F.col("run_no")])


def replace_empty_viewpoints(first: DataFrame, retry: DataFrame) -> DataFrame:
    """AGG-15 (event scope): a retry replaces a viewpoint feed that came back empty.

    Both ``(feed_name, ok, article_count)``; a retry is used if it has articles or the
    first run failed.
    """
    r = retry.select("feed_name", F.col("ok").alias("ro"), F.col("article_count").alias("rc"))
    use = F.col("rc").isNotNull() & (F.col("article_count") == 0) & ((F.col("rc") > 0) | ~F.col("ok"))
    return first.join(r, "feed_name", "left").select(
        "feed_name", F.when(use, F.col("ro")).otherwise(F.col("ok")).alias("ok"),
        F.when(use, F.col("rc")).otherwise(F.col("article_count")).alias("article_count"),
    )


def audit_world_feed(directory: DataFrame, feeds: DataFrame, articles: DataFrame, top_events: DataFrame, as_of, expected_empty=tuple(dims.EXPECTED_EMPTY_COUNTRIES)) -> DataFrame:
    """AGG-16: (country_name, failure) rows.

    ``feeds(country_name, generated_at)``, ``articles(country_name, publisher_name, url,
    published_at)``, ``top_events(country_name, category, importance_score,
    last_updated_at)``; country_name null marks the whole feed.
    """
    at = ts(as_of)
    bad = (F.trim(F.coalesce("publisher_name", F.lit(""))) == "") | ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)) | F.col("published_at").isNull()
    per = articles.groupBy("country_name").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    rows = (
        directory.select("country_name")
        .join(feeds.select("country_name", F.lit(True).alias("present")), "country_name", "left")
        .join(per, "country_name", "left")
        .join(top_events.select("country_name", "category", "importance_score", F.col("last_updated_at").alias("top_at")), "country_name", "left")
    )
    has = F.coalesce("n", F.lit(0)) > 0
    event = F.col("top_at").isNotNull()
    expected = F.col("country_name").isin(*expected_empty) if expected_empty else F.lit(False)
    checks = [
        ("missing from complete world response", F.col("present").isNull()),
        ("inhabited country has no live news", F.col("present").isNotNull() & ~has & ~expected),
        ("expected-empty country has news", has & expected),
        ("articles did not produce an event", has & ~event),
        ("top event is stale", has & event & (F.col("top_at") < at - F.expr("INTERVAL 8 DAYS"))),
        ("invalid article metadata", has & (F.col("bad") > 0)),
        ("neutral color despite top event", has & event & (scoring.fill_color(F.col("category"), F.col("importance_score")) == dims.COLOR_NO_CATEGORY)),
    ]
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in checks])
    per_country = rows.select("country_name", F.explode(F.array_compact(flags)).alias("failure"))
    stale = feeds.agg(F.max("generated_at").alias("g")).filter(
        F.col("g").isNull() | (F.unix_micros(at) - F.unix_micros("g") > 120_000_000)
    ).select(F.lit(None).cast("string").alias("country_name"), F.lit("complete world feed is more than two minutes old").alias("failure"))
    return per_country.unionByName(stale)


def stalest_countries(directory: DataFrame, attempts: DataFrame) -> DataFrame:
    """TOP-6: directory countries by oldest attempt, never-attempted first."""
    last = attempts.groupBy("country_name").agg(F.max("last_attempt_at").alias("last_attempt_at"))
    return directory.select("country_name", "ord").join(last, "country_name", "left").withColumn(
        "last_attempt_at", F.coalesce("last_attempt_at", F.timestamp_seconds(F.lit(0)))
    ).orderBy("last_attempt_at", "ord")


def world_feed(directory: DataFrame, feeds: DataFrame, articles: DataFrame, k: int | None = None) -> DataFrame:
    """SNK-2 rows: every directory country in order with its valid articles; ``k`` keeps the first ones only."""
    valid = filter_event_titles(articles)
    capped = top_rows(valid, ["country_name"], [F.col("pos"), F.col("id")], k, "_k")
    item = F.struct("id", "title", "url", "publisher_name", "published_at")
    lists = capped.groupBy("country_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("_k"), item.alias("a")))), lambda p: p["a"]).alias("articles")
    )
    out = directory.select("ord", "country_name").join(feeds.select("country_name", "generated_at"), "country_name", "left").join(lists, "country_name", "left")
    return out.select(
        "ord", "country_name", F.coalesce("generated_at", F.timestamp_seconds(F.lit(0))).alias("generated_at"),
        F.coalesce("articles", F.array().cast(lists.schema["articles"].dataType)).alias("articles"),
    ).withColumn("available", F.size("articles") > 0).orderBy("ord")


def world_feed_pages(directory: DataFrame, feeds: DataFrame, articles: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """SNK-2 rows in pages: every directory country with all its valid articles, at most ``page_rows`` a row."""
    item = F.struct("id", "title", "url", "publisher_name", "published_at")
    pages = paged(filter_event_titles(articles), ["country_name"], F.floor(F.col("pos") / 4096), [F.col("pos"), F.col("id")], item, page_rows)
    heads = directory.select("ord", "country_name").join(feeds.select("country_name", "generated_at"), "country_name", "left")
    out = complete_pages(heads.withColumn("generated_at", F.coalesce("generated_at", F.timestamp_seconds(F.lit(0)))), pages, ["country_name"])
    return out.select("ord", "country_name", "generated_at", "page", "n_pages", "total", F.col("items").alias("articles"), (F.col("total") > 0).alias("available"))
