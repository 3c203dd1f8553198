"""Event queries: filters, rankings, pages and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.grouping import complete_pages, first_row, highest, newest, paged
from newsloom.session import ts

TIME_RANGES = {"24 hours": 24, "3 days": 72, "7 days": 168}


def strongest() -> list[Column]:
    return [F.desc("importance_score"), F.desc("last_updated_at"), F.asc("event_id")]


def rank_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """TOP-1 (and TOP-5 with a limit)."""
    out = events.orderBy(*strongest())
    return out.limit(limit) if limit else out


def filter_events(events: DataFrame, as_of, category: str | None = None, label: str | None = None, time_range: str | None = None, search: str = "") -> DataFrame:
    """FLT-7: interactive filters; the search also looks at every publisher name."""
    out = events
    if category:
        out = out.filter(F.col("category") == category)
    if label:
        out = out.filter(F.col("importance_label") == label)
    if time_range in TIME_RANGES:
        out = out.filter(F.col("last_updated_at") >= ts(as_of) - F.expr(f"INTERVAL {TIME_RANGES[time_range]} HOURS"))
    needle = search.strip().lower()
    if needle:
        has = lambda c: F.lower(c).contains(needle)
        out = out.filter(
            has(F.col("headline")) | has(F.col("summary")) | F.exists("articles", lambda a: has(a["publisher_name"]))
        )
    return out


def query_events(events: DataFrame, bridge: DataFrame | None = None, country: str | None = None, category: str | None = None, importance: str | None = None, search: str | None = None) -> DataFrame:
    """FLT-8 with JOIN-11: active events; ``%`` and ``_`` in the search are wildcards."""
    out = events.filter("active")
    if country:
        codes = bridge.filter(F.col("country_code") == country.upper()).select("event_id").distinct()
        out = out.join(codes, "event_id", "left_semi")
    if category:
        out = out.filter(F.col("category") == category)
    if importance:
        out = out.filter(F.col("importance_label") == importance)
    if search:
        pattern = f"%{search.strip()}%"
        out = out.filter(F.col("headline").ilike(pattern) | F.col("summary").ilike(pattern))
    return out


def events_by_country(events: DataFrame, bridge: DataFrame, countries: DataFrame) -> DataFrame:
    """JOIN-11: the m:n join of events and countries."""
    return bridge.join(F.broadcast(countries), "country_code").join(events, "event_id")


def paginate_events(events: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """TOP-4: one page, strongest first."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page >= 1 and 1 <= page_size <= 100")
    return events.orderBy(*strongest()).offset((page - 1) * page_size).limit(page_size)


def count_events(events: DataFrame, page_size: int = 20) -> DataFrame:
    """AGG-10: total and number of pages."""
    return events.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / page_size).cast("long"))


def assemble_event_documents(events: DataFrame, bridge: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG-11: events with nested country codes and articles including their source."""
    codes = bridge.groupBy("event_id").agg(F.sort_array(F.collect_set("country_code")).alias("affected_countries"))
    item = F.struct(
        "published_at", "id", "headline", "original_url",
        F.struct("source_id", "publisher_name", "source_url", "prominence_score").alias("source"),
    )
    nested = (
        articles.join(sources, "source_id").groupBy("event_id")
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("articles"))
    )
    out = events.join(codes, "event_id", "left").join(nested, "event_id", "left")
    return out.withColumns({
        "affected_countries": F.coalesce("affected_countries", F.array().cast("array<string>")),
        "articles": F.coalesce("articles", F.array().cast(nested.schema["articles"].dataType)),
    })


def event_document_pages(events: DataFrame, bridge: DataFrame, articles: DataFrame, sources: DataFrame, page_rows: int = 200) -> DataFrame:
    """AGG-11 in pages: each event with its country codes and its articles, newest first, at most ``page_rows`` a row."""
    codes = bridge.groupBy("event_id").agg(F.sort_array(F.collect_set("country_code")).alias("affected_countries"))  # at most the countries
    item = F.struct("published_at", "id", "headline", "original_url", F.struct("source_id", "publisher_name", "source_url", "prominence_score").alias("source"))
    rows = articles.join(sources, "source_id")
    pages = paged(rows, ["event_id"], F.floor(newest("published_at") / 3_600_000_000), [newest("published_at"), F.desc("id")], item, page_rows)
    out = complete_pages(events.join(codes, "event_id", "left"), pages, ["event_id"])
    return out.withColumn("affected_countries", F.coalesce("affected_countries", F.array().cast("array<string>"))).withColumnRenamed("items", "articles")



def breaking_events(global_events: DataFrame, country_top_events: DataFrame, k: int = 10) -> DataFrame:
    """TOP-2: newest global events, or the countries' top events when there are none."""
    some = global_events.limit(1).agg((F.count("*") > 0).alias("_some"))
    cols = global_events.columns
    pool = global_events.withColumn("_g", F.lit(True)).unionByName(country_top_events.select(*cols).withColumn("_g", F.lit(False)))
    pool = pool.join(F.broadcast(some)).filter(F.col("_g") == F.col("_some")).drop("_g", "_some")
    one = first_row(pool, ["event_id"], [newest("last_updated_at"), highest("importance_score")])
    return one.orderBy(F.desc("last_updated_at"), F.desc("importance_score"), "event_id").limit(k)


def situation_briefing(events: DataFrame, k: int = 12) -> DataFrame:
    """TOP-3: the strongest events with one source each, preferably one with an image."""
    top = events.orderBy(*strongest()).limit(k)
    with_image = F.filter("articles", lambda a: F.coalesce(a["image_url"], F.lit("")) != "")
    source = F.coalesce(F.try_element_at(with_image, F.lit(1)), F.try_element_at(F.col("articles"), F.lit(1)))
    return top.withColumn("source", source)
