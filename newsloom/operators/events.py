"""AGG-1, AGG-6, SCORE-1/2: from clustered articles to scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import scoring, text as tx
from newsloom.operators import classify as cl, cluster as cu, publishers as pub, similarity as sm
from newsloom.operators.grouping import first_row, newest
from newsloom.operators.quality import filter_event_titles
from newsloom.session import computed, cut, hours_between, small_side, ts

# Fixed pattern.
BOILERPLATE = (
    r"(?i)^(?:expanded topic search|current reporting indexed|current reporting from|browse current"
    r"|open the source|the displayed reports|live coverage)"
)
ARTICLE_FIELDS = [
    "id", "headline", "url", "image_url", "publisher_name", "publisher_url", "publisher_key",
    "prominence", "published_at", "category",
]


def score_events(df: DataFrame, half_even: bool = False) -> DataFrame:
    """SCORE-1/2: adds scoring components, importance_score and importance_label.

    Reads independent_source_count, affected_country_count, age_hours, articles_per_hour.
    """
    s = scoring.score_struct(
        F.col("independent_source_count"), F.col("affected_country_count"), F.col("age_hours"),
        F.col("articles_per_hour"), half_even,
    )
    df = df.drop("scoring_components", "importance_score", "importance_label").withColumn("_s", s)
    return df.withColumns({
        "importance_score": F.col("_s.score"),
        "importance_label": F.col("_s.label"),
        "scoring_components": F.col("_s").dropFields("score", "label"),
    }).drop("_s")


def reporting(first: Column, last: Column, n: Column) -> tuple[Column, Column]:
    """(coverage window in hours, reports per hour); one report has neither."""
    window = F.when(n <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0) / 60, hours_between(last, first)))
    return window, F.when(n <= 1, F.lit(0.0)).otherwise((n - 1) / window)


def summary_parts(description: Column) -> tuple[Column, Column, Column]:
    """(cleaned text, usable?, sort key: complete sentences first, then shorter ones)."""
    clean = tx.clean_feed_text(description)
    usable = (F.length(clean) >= 35) & ~clean.rlike(BOILERPLATE)
    complete = clean.rlike(r"[.!?]$")
    return clean, usable, F.struct(F.when(complete, 0).otherwise(1).alias("a"), F.length(clean).alias("b"))


def first_sentence(c: Column) -> Column:
    s = F.trim(F.regexp_extract(c, r"^.*?[.!?](?:\s|$)", 0))
    return F.when(s == "", c).otherwise(s)


def headline_sentence(headline: Column) -> Column:
    return F.concat(F.regexp_replace(tx.clean_feed_text(headline), r"[.!?]+$", ""), F.lit("."))


def choose_summary(texts: DataFrame, heads: DataFrame, key: str, fallback: Column | None = None) -> DataFrame:
    """AGG-6: (key, summary).

    ``texts(key, description, published_at, id)`` are candidate descriptions, ``heads(key,
    headline[, ...])`` one row per group. Combines map-side, one candidate per group.
    """
    clean, usable, order = summary_parts(F.col("description"))
    found = (
        computed(texts, "*", clean.alias("_c"), order.alias("_o"), usable.alias("_u")).filter("_u").drop("_u", "description")
        .join(small_side(heads.select(key, F.lower(tx.clean_feed_text(F.col("headline"))).alias("_head"))), key)
        .filter(F.lower("_c") != F.col("_head"))
        .groupBy(key)
        .agg(F.min_by("_c", F.struct("_o", newest("published_at").alias("t"), "id")).alias("_best"))
    )
    return _summaries(heads, found, key, fallback)


def choose_shared_summary(pairs: DataFrame, texts: DataFrame, heads: DataFrame, key: str, fallback: Column | None = None) -> DataFrame:
    """AGG-6 where a text is a candidate of many groups: ``pairs(key, row)`` and ``texts(row, description, published_at, id)``.

    A text is cleaned once, and only the chosen ones are brought to their groups.
    """
    clean, usable, order = summary_parts(F.col("description"))
    texts = cut(computed(texts, "row", "published_at", "id", clean.alias("_c"), order.alias("_o"), usable.alias("_u")).filter("_u").drop("_u"))
    named = small_side(heads.select(key, F.md5(F.lower(tx.clean_feed_text(F.col("headline")))).alias("_head")))
    chosen = (
        pairs.join(texts.select("row", "published_at", "id", "_o", F.md5(F.lower("_c")).alias("_text")), "row").join(named, key)
        .filter(F.col("_text") != F.col("_head"))
        .groupBy(key)
        .agg(F.min_by("row", F.struct("_o", newest("published_at").alias("t"), "id")).alias("row"))
    )
    return _summaries(heads, chosen.join(texts.select("row", F.col("_c").alias("_best")), "row").drop("row"), key, fallback)


def _summaries(heads: DataFrame, found: DataFrame, key: str, fallback: Column | None) -> DataFrame:
    fb = tx.clean_feed_text(fallback) if fallback is not None else F.lit("")
    text = (
        F.when(F.col("_best").isNotNull(), first_sentence(F.col("_best")))
        .when((fb != "") & ~fb.rlike(BOILERPLATE), fb)
        .otherwise(headline_sentence(F.col("headline")))
    )
    return heads.join(found, key, "left").select(key, tx.truncate_words(text).alias("summary"))


def with_publisher(articles: DataFrame) -> DataFrame:
    """publisher_key, prominence and bucket as expressions over bounded fixed tables."""
    df = articles.withColumn("publisher_key", tx.publisher_key(F.col("publisher_name")))
    ratings = F.create_map(*[F.lit(x) for k, b, _ in dims.PUBLISHER_RATINGS for x in (k, b)])
    return df.withColumns({
        "prominence": pub.prominence_of(F.col("publisher_key")),
        "bucket": F.try_element_at(ratings, F.col("publisher_key")),
    })


def with_defaults(articles: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("image_url", "url", "publisher_url", "description") if c not in articles.columns}
    return articles.withColumns(missing) if missing else articles


ROW_MARK = r"~[0-9a-f]{32}~\d+$"


def unique_rows(articles: DataFrame) -> DataFrame:
    """Rows that share an id get an id of their own: a 128-bit hash of the row and its position behind the id.

    Display ids are 32-bit hashes, and two feeds may use one guid; joins need one id per row.
    """
    articles = cut(articles)
    shared = cut(articles.groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("id", F.lit(True).alias("_shared")))
    if shared.isEmpty():
        return articles
    named = F.md5(F.concat_ws("\u0001", "title", "url", "publisher_name", F.col("published_at").cast("string")))
    own = F.concat_ws("~", "id", named, F.monotonically_increasing_id().cast("string"))
    marked = articles.join(shared, "id", "left")
    return cut(marked.withColumn("id", F.when(F.col("_shared"), own).otherwise(F.col("id"))).drop("_shared"))


def article_struct() -> Column:
    return F.struct(*[F.col(c) for c in ARTICLE_FIELDS])


def sorted_articles(order: list[Column]) -> Column:
    """collect a bounded (top-k) article list in ``order``."""
    pairs = F.collect_list(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), article_struct().alias("a")))
    return F.transform(F.sort_array(pairs), lambda p: p["a"])


def build_events(
    articles: DataFrame, as_of, lexicon: dims.Lexicon, country: str | None = None, top: int = 5,
    hours: int = sm.LINK_HOURS, block_rows: int = sm.BLOCK_ROWS, dense_rows: int = sm.TILE_ROWS,
    scope: str | None = None,
) -> DataFrame:
    """AGG-1: articles to one scored event per cluster (unordered; see ``rank_events``).

    ``country`` anchors all events to one identifier; without it they are GLOBAL.
    ``scope`` names a column of country identifiers instead: the articles of each country
    are clustered on their own, all countries in one job. Rows may share an id: each counts on its own.
    """
    at = ts(as_of)
    base = unique_rows(with_defaults(filter_event_titles(articles).filter(F.col("published_at").isNotNull())))
    assigned, reports, similar = cu.cluster_articles(base, lexicon, hours, block_rows, dense_rows, scope)
    rows = with_publisher(
        base.select("id", (F.col(scope) if scope else F.lit(country or "GLOBAL")).alias("scope"), "title", "description", "image_url", "url", "publisher_name", "publisher_url")
    ).join(assigned.select("id", "published_at", "category", "report", "cluster_id"), "id")
    rows = cut(rows)
    stats = rows.groupBy("cluster_id").agg(
        F.count("*").alias("article_count"), F.min("published_at").alias("first_seen_at"),
        F.max("published_at").alias("last_updated_at"), F.first("scope").alias("primary_country"),
    )
    reps = cu.representative_articles(rows.select("cluster_id", "report", "id", "published_at", "prominence"), reports, similar, hours)
    heads = cut(
        reps.join(rows.select("id", F.col("title").alias("headline"), F.col("category").alias("headline_category")), "id")
        .select("cluster_id", "headline", "headline_category")
    )
    vague = heads.filter("headline_category = 'Local affairs'").select("cluster_id")
    reread = cl.classify_groups(
        rows.join(vague, "cluster_id", "left_semi").select("cluster_id", F.concat_ws(" ", "title", "description").alias("t")),
        "cluster_id", "t", lexicon,
    )
    heads = cut(
        heads.join(reread.withColumnRenamed("category", "_again"), "cluster_id", "left").select(
            "cluster_id", "headline", F.coalesce("_again", "headline_category").alias("event_category")
        )
    )
    latest = pub.latest_article_per_publisher(rows.drop("description", "report"), ["cluster_id"])
    sources = latest.groupBy("cluster_id").agg(F.count("*").alias("independent_source_count"))
    visible = pub.balanced_top_sources(
        latest.join(heads.select("cluster_id", "event_category"), "cluster_id"), ["cluster_id"], top,
        pub.shows_perspective(F.col("event_category")),
    ).withColumns({"headline": F.col("title"), "id": F.regexp_replace("id", ROW_MARK, "")})
    lists = visible.groupBy("cluster_id").agg(sorted_articles([newest("published_at"), F.col("rank")]).alias("articles"))
    summaries = choose_summary(rows.select("cluster_id", "description", "published_at", "id"), heads, "cluster_id")
    n = F.col("article_count")
    window, rate = reporting(F.col("first_seen_at"), F.col("last_updated_at"), n)
    local = F.col("primary_country") != "GLOBAL"
    events = (
        heads.join(stats, "cluster_id").join(sources, "cluster_id").join(lists, "cluster_id").join(summaries, "cluster_id")
        .withColumns({
            "coverage_window_hours": window,
            "articles_per_hour": rate,
            "age_hours": F.greatest(F.lit(0.0), hours_between(at, F.col("last_updated_at"))),
            "affected_country_count": F.lit(1),
        })
    )
    events = score_events(events).select(
        F.concat(F.lit("live-event-"), tx.stable_id(F.lower("headline"))).alias("id"),
        "cluster_id", "headline", "summary", F.col("event_category").alias("category"),
        "importance_score", "importance_label",
        F.when(local, "National").otherwise("International").alias("geographic_scope"),
        "primary_country",
        F.when(local, F.array("primary_country")).otherwise(F.array().cast("array<string>")).alias("affected_countries"),
        "first_seen_at", "last_updated_at", "independent_source_count", "affected_country_count",
        "age_hours", "article_count", "coverage_window_hours", "articles_per_hour", "scoring_components", "articles",
    )
    return cut(events)
