"""JOIN-1..4, JOIN-18, FLT-6: which countries a text names.

A text is reduced to its word runs, the runs meet the gazetteer in one equi-join, and
only those few candidates are checked against the exact term pattern. Work grows with the
text, not with text x gazetteer, and nothing is shuffled before the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.events import score_events
from newsloom.session import is_small, small_side

EDGE = r"[^\p{L}\p{N}]"


def prepare_gazetteer(terms: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """country, term -> country, term, key, n_words, case_sensitive.

    Countries in ``overrides(country, term)`` have ambiguous names: only their override
    terms count. Two- and three-letter capitals are case-sensitive.
    """
    terms = terms.select("country", F.trim("term").alias("term")).filter("term <> ''")
    if overrides is not None:
        terms = terms.join(F.broadcast(overrides.select("country").distinct()), "country", "left_anti").unionByName(
            overrides.select("country", "term")
        )
    key = tx.title_key(F.col("term"))
    return terms.distinct().select(
        "country", "term", key.alias("key"), F.size(F.split(key, " ")).alias("n_words"),
        F.col("term").rlike(r"^[A-Z]{2,3}$").alias("case_sensitive"),
    )


def _exact(text: Column, term: Column, case_sensitive: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    pattern = F.concat(
        F.when(case_sensitive, F.lit("")).otherwise(F.lit("(?iu)")),
        F.lit(f"(?:^|{EDGE})"), quoted, F.lit(f"(?:{EDGE}|$)"),
    )
    return F.regexp_like(text, pattern)


def match_countries(df: DataFrame, gazetteer: DataFrame, text: str = "text", key: str = "id", longest: int | None = None) -> DataFrame:
    """JOIN-1: distinct (key, country) named by ``text``.

    With a gazetteer that can be broadcast the texts stay where they are. With a larger one only word runs
    are shuffled, and the few hits fetch their text afterwards.
    """
    if longest is None:
        longest = gazetteer.agg(F.max("n_words")).first()[0] or 1
    g = gazetteer.select(F.col("key").alias("key_"), "country", "term", "case_sensitive")
    texts = df.select(key, F.col(text).alias("_x"))
    run = F.explode(tx.word_grams(F.col("_x"), longest)).alias("key_")
    if is_small(g):
        hits = texts.select(key, "_x", run).join(F.broadcast(g), "key_")
    else:
        hits = texts.select(key, run).join(g, "key_").select(key, "country", "term", "case_sensitive").distinct().join(texts, key)
    return hits.filter(_exact(F.col("_x"), F.col("term"), F.col("case_sensitive"))).select(key, "country").distinct()


def reject_homonyms(matches: DataFrame, texts: DataFrame, rules: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """JOIN-2: keep a match of a ruled country only in a fitting context.

    ``rules(country, must_match, reject_if, unless)`` hold patterns or null: the text has
    to match must_match, and must not match reject_if unless it matches ``unless``.
    """
    ruled = matches.join(small_side(rules), "country", "left")
    x = F.col(text)
    hit = lambda c: F.coalesce(F.regexp_like(x, F.col(c)), F.lit(False))
    plain = ruled.filter("must_match is null and reject_if is null").select(key, "country")
    checked = (
        ruled.filter("must_match is not null or reject_if is not null").join(texts.select(key, text), key)
        .filter((F.col("must_match").isNull() | hit("must_match")) & ~(hit("reject_if") & ~hit("unless")))
        .select(key, "country")
    )
    return plain.unionByName(checked)


def filter_relevant_to_country(
    articles: DataFrame, gazetteer: DataFrame, rules: DataFrame | None = None, longest: int | None = None
) -> DataFrame:
    """FLT-6: keep articles that name their requested ``country_name``.

    Broad feeds (``broad_feed`` true) must name it in the headline, country searches
    anywhere in the searchable text.
    """
    body = F.col("searchable_text") if "searchable_text" in articles.columns else F.concat_ws(" ", "title", "description")
    texts = articles.select("id", "country_name", F.when(F.col("broad_feed"), F.col("title")).otherwise(body).alias("text"))
    wanted = gazetteer.join(small_side(articles.select(F.col("country_name").alias("country")).distinct()), "country", "left_semi")
    found = match_countries(texts, wanted, longest=longest)
    if rules is not None:
        found = reject_homonyms(found, texts, rules)
    return articles.join(found.withColumnRenamed("country", "country_name"), ["id", "country_name"], "left_semi")


def articles_mentioning_country(articles: DataFrame, gazetteer: DataFrame, country: str) -> DataFrame:
    """JOIN-4."""
    texts = articles.select("id", F.concat_ws(" ", "title", "description").alias("text"))
    found = match_countries(texts, gazetteer.filter(F.col("country") == country))
    return articles.join(found.select("id"), "id", "left_semi")


def event_text() -> Column:
    return F.concat_ws(" ", F.col("headline"), F.array_join(F.transform("articles", lambda a: a["headline"]), " "))


def regeo(events: DataFrame, affected: Column) -> DataFrame:
    """Replace the affected countries and everything that follows from them."""
    df = events.withColumn("affected_countries", affected)
    n = F.size("affected_countries")
    return score_events(
        df.withColumns({
            "affected_country_count": F.greatest(F.lit(1), n),
            "geographic_scope": F.when(n > 1, "International").otherwise(F.col("geographic_scope")),
            "primary_country": F.when(
                (F.col("primary_country") == "GLOBAL") & (n > 0), F.try_element_at("affected_countries", F.lit(1))
            ).otherwise(F.col("primary_country")),
        })
    )


def detect_event_countries(
    events: DataFrame, gazetteer: DataFrame, directory: DataFrame, key: str = "cluster_id", anchor: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """JOIN-3: affected countries from headline and article headlines, then rescoring.

    ``directory(ord, name, iso2)`` gives identifiers and their order. ``anchor`` names a
    country that is appended where it was not found.
    """
    texts = events.select(key, event_text().alias("text"))
    ident = F.coalesce("iso2", "name")
    d = small_side(directory.select(F.col("name").alias("country"), ident.alias("ident"), "ord"))
    found = match_countries(texts, gazetteer, key=key, longest=longest).join(d, "country").groupBy(key).agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("ord", "ident"))), lambda s: s["ident"])).alias("_found")
    )
    joined = events.join(found, key, "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    if anchor:
        joined = joined.withColumn("_found", F.array_distinct(F.concat("_found", F.array(F.lit(anchor)))))
    affected = (
        F.when(F.size("_found") > 0, F.col("_found"))
        .when(F.size("affected_countries") > 0, F.array_distinct("affected_countries"))
        .when(F.col("primary_country") != "GLOBAL", F.array("primary_country"))
        .otherwise(F.array().cast("array<string>"))
    )
    return regeo(joined, affected).drop("_found")


# --- names and codes ------------------------------------------------------------------
_ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįñńňòóôõöøōőùúûüūůűýÿžźżšśßťţțșşřğłľĺ"
_PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiinnnoooooooouuuuuuuyyzzzsssstttssrglll"


def country_name_key(c: Column) -> Column:
    """Accent-free lower-case key of a country name."""
    plain = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def resolve_country_codes(
    names: DataFrame, codes: DataFrame, aliases: DataFrame, languages: DataFrame, column: str = "name"
) -> DataFrame:
    """JOIN-18: ISO-2 by canonical name, then by raw name; language by region, US/en by default.

    ``codes(name, iso2)``, ``aliases(name, canonical)``, ``languages(iso2, language)``.
    """
    code_keys = small_side(codes.select(country_name_key(F.col("name")).alias("k"), F.col("iso2")).dropDuplicates(["k"]))
    alias = small_side(aliases.select(F.col("name").alias(column), "canonical"))
    df = names.join(alias, column, "left").withColumn("canonical", F.coalesce("canonical", column))
    for out, source in (("_by_canonical", "canonical"), ("_by_raw", column)):
        df = df.withColumn("k", country_name_key(F.col(source))).join(code_keys, "k", "left").withColumnRenamed("iso2", out).drop("k")
    df = df.withColumn("country_code", F.coalesce("_by_canonical", "_by_raw")).withColumn(
        "region", F.coalesce("country_code", F.lit("US"))
    )
    lang = small_side(languages.select(F.col("iso2").alias("region"), "language"))
    return df.join(lang, "region", "left").withColumn("language", F.coalesce("language", F.lit("en"))).drop("_by_canonical", "_by_raw")
