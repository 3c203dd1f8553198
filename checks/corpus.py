"""News-shaped views over the driver's tables, with fixed small dimensions.

Title is the first line of a document and description the rest of its text; the
publication time is the timestamp of the event with the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.operators.events import score_events, reporting
from newsloom.session import hours_between, ts

AS_OF = "2024-01-05 00:00:00"

# Lexicon over words of the corpus, one list per category.
LEXICON = {
    "Conflict and security": ["thanedble", "attion", "of the"],
    "Crime and justice": ["eriner", "thanea", "is that"],
    "Weather and disasters": ["rewh", "thatin", "de la"],
    "Health": ["ononst", "inoran"],
    "Science and technology": ["hehely", "orantion", "und die"],
    "Sports": ["orre", "anea", "in the"],
    "Culture and entertainment": ["thon", "avec", "with the"],
    "Environment": ["nicht", "dans", "anon"],
    "Economy": ["thth", "tion", "to the"],
    "Politics": ["eren", "thor", "and the"],
    "Travel and transport": ["von", "erer"],
    "Food and agriculture": ["pour", "thes"],
    "Society and education": ["por", "than", "for the"],
}
LEX = dims.lexicon_from(LEXICON)

# country, term: words, phrases and one case-sensitive acronym of the corpus.
GAZETTEER = [
    ("NATION_0", "thanedble"), ("NATION_1", "attion"), ("NATION_2", "eriner"), ("NATION_3", "thanea"),
    ("NATION_4", "orre"), ("NATION_5", "rewh"), ("NATION_6", "thatin"), ("NATION_7", "ononst"),
    ("NATION_8", "inoran"), ("NATION_9", "hehely"), ("NATION_10", "orantion"), ("NATION_11", "in the"),
    ("NATION_12", "de la"), ("NATION_13", "TH"), ("NATION_14", "anea"), ("NATION_15", "und die"),
    ("NATION_16", "thon"), ("NATION_17", "for the and"), ("NATION_18", "nicht"), ("NATION_19", "avec"),
    ("NATION_20", "tion of"), ("NATION_21", "erin"), ("NATION_22", "zu"), ("NATION_23", "los"), ("NATION_4", "st ed"),
]
OVERRIDES = [("NATION_3", "thanea the"), ("NATION_3", "the thanea")]
HOMONYMS = [("NATION_0", None, "rewh", "attion"), ("NATION_4", "orre.{0,40}of", None, None)]
LONGEST = 3
RATINGS = [("src1", "left", "Left"), ("src2", "left", "Lean Left"), ("src3", "center", "Center"), ("src4", "center", "Center"),
           ("src5", "right", "Right"), ("src6", "right", "Lean Right"), ("src7", "center", "Center"), ("src12", "left", "Left")]
PROMINENCE = [(0, "src1", 90), (1, "src12", 80), (2, "2", 70), (3, "rc7", 65), (4, "src", 60)]
EMPTY = ("NATION_24", "EMPTY_1")  # expected to have no news; one of them has


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("published_at"),
        F.col("event_type").alias("feed_name"), "user_id",
    )
    first = F.substring_index("text", "\n", 1)
    # The driver writes one row group per table; spread it before per-row text work.
    return d.join(e, "doc_id").repartition("doc_id").select(
        F.format_string("a%08d", "doc_id").alias("id"),
        first.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("description"),
        F.format_string("https://www.%s.example/%s/n%d", "source", "lang", "n_chars").alias("url"),
        F.col("source").alias("publisher_name"),
        F.col("lang").alias("language"),
        "published_at", "feed_name", "user_id", "doc_id", "n_chars",
        F.format_string("NATION_%d", F.col("user_id") % 25).alias("country_name"),
    )


def directory(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("country_name"),
        F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("map_id"),
        F.when(F.col("n_regionkey") < 3, F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))).alias("iso2"),
    )


def wide_directory(spark: SparkSession, sf: str) -> DataFrame:
    """The directory and three countries without any data: EMPTY_0, EMPTY_1, EMPTY_2."""
    more = spark.range(3).select(
        (F.col("id") + 100).alias("ord"), F.concat(F.lit("EMPTY_"), F.col("id").cast("string")).alias("country_name"),
        F.concat(F.lit("m"), (F.col("id") + 100).cast("string")).alias("map_id"), F.lit(None).cast("string").alias("iso2"),
    )
    return directory(spark, sf).unionByName(more)


def gazetteer(spark: SparkSession, overrides: bool = True) -> DataFrame:
    from newsloom.operators.countries import prepare_gazetteer

    terms = spark.createDataFrame(GAZETTEER, "country string, term string")
    return prepare_gazetteer(terms, spark.createDataFrame(OVERRIDES, "country string, term string") if overrides else None)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOMONYMS, "country string, must_match string, reject_if string, unless string")


def stories(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """One event per (source, language): scored, with its first article as headline."""
    a = articles(spark, sf)
    g = a.groupBy("publisher_name", "language").agg(
        F.min("id").alias("first_id"), F.count("*").alias("article_count"),
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at"),
        F.countDistinct("feed_name").alias("independent_source_count"),
        F.countDistinct("country_name").alias("affected_country_count"),
    )
    heads = a.select(F.col("id").alias("first_id"), F.col("title").alias("headline"), F.col("description").alias("summary"))
    _, rate = reporting(F.col("first_seen_at"), F.col("last_updated_at"), F.col("article_count"))
    category = F.create_map(*[F.lit(x) for kv in STORY_CATEGORY.items() for x in kv])
    g = g.join(heads, "first_id").withColumns({
        "event_id": F.concat_ws("-", F.lit("e"), "publisher_name", "language"),
        "category": F.try_element_at(category, F.col("language")),
        "articles_per_hour": rate,
        "age_hours": F.greatest(F.lit(0.0), hours_between(ts(as_of), F.col("last_updated_at"))),
        "active": F.col("article_count") > 1,
    })
    return score_events(g)


STORY_CATEGORY = {"en": "Politics", "fr": "Economy", "de": "Sports", "es": "Health"}


def story_bridge(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.select(
        F.concat_ws("-", F.lit("e"), "publisher_name", "language").alias("event_id"), F.col("country_name").alias("country_code")
    ).distinct()
