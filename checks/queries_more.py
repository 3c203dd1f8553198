"""Registered queries: countries, merging, feeds, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import corpus as c, sql as s
from checks.queries_base import ART, _ratings, case, us
from newsloom.functions import text as tx
from newsloom.operators import classify as cl, countries as co, events as ev, feeds as fd, grouping as gr, merge as mg, serving as sv
from newsloom.session import cut, ts

FULL = "txt AS (SELECT id, concat_ws(' ', title, description) AS text, title, country_name, feed_name FROM art)"


def _texts(spark, sf):
    return c.articles(spark, sf).select("id", F.concat_ws(" ", "title", "description").alias("text"))


# --- countries ----------------------------------------------------------------------------
@case("join_match_countries", f"{ART}, {FULL} SELECT id, country FROM {s.mentions('txt', 'id', 'text')}")
def match(spark, sf):
    return co.match_countries(_texts(spark, sf), c.gazetteer(spark), longest=c.LONGEST)


_RULED = """SELECT m.id, m.country FROM m JOIN txt USING (id) WHERE
  NOT (country = 'NATION_0' AND regexp_matches(text, 'rewh') AND NOT regexp_matches(text, 'attion'))
  AND NOT (country = 'NATION_4' AND NOT regexp_matches(text, 'orre.{0,40}of'))"""


@case("join_reject_homonyms", f"{ART}, {FULL}, m AS {s.mentions('txt', 'id', 'text')} {_RULED}")
def homonyms(spark, sf):
    t = _texts(spark, sf)
    return co.reject_homonyms(co.match_countries(t, c.gazetteer(spark), longest=c.LONGEST), t, c.rules(spark))


@case("flt_relevant_to_country", f"""{ART}, {FULL}, part AS (SELECT id, country_name, CASE WHEN feed_name = 'view' THEN title ELSE text END AS text FROM txt),
 m AS {s.mentions('part', 'id', 'text')}, ok AS ({_RULED.replace('txt', 'part')})
 SELECT a.id, a.country_name FROM art a JOIN ok ON ok.id = a.id AND ok.country = a.country_name""")
def relevant(spark, sf):
    a = c.articles(spark, sf).withColumn("broad_feed", F.col("feed_name") == "view")
    return co.filter_relevant_to_country(a, c.gazetteer(spark), c.rules(spark), c.LONGEST).select("id", "country_name")


@case("join_articles_mentioning", f"{ART}, {FULL} SELECT id FROM {s.mentions('txt', 'id', 'text')} WHERE country = 'NATION_11'")
def mentioning(spark, sf):
    return co.articles_mentioning_country(c.articles(spark, sf), c.gazetteer(spark), "NATION_11").select("id")


def _story_events(spark, sf):
    """Stories in the shape of built events, with up to five nested articles."""
    st = c.stories(spark, sf)
    a = ev.with_publisher(c.articles(spark, sf).withColumns({
        "event_id": F.concat_ws("-", F.lit("e"), "publisher_name", "language"),
        "headline": F.col("title"), "image_url": F.lit(None).cast("string"),
        "publisher_url": F.lit(None).cast("string"), "category": F.lit("Other"),
    }))
    top = gr.top_rows(a, ["event_id"], [gr.newest("published_at"), F.col("id")], 5)
    lists = top.groupBy("event_id").agg(ev.sorted_articles([F.col("rank")]).alias("articles"))
    return st.join(lists, "event_id").withColumns({
        "coverage_window_hours": ev.reporting(F.col("first_seen_at"), F.col("last_updated_at"), F.col("article_count"))[0],
        "primary_country": F.lit("GLOBAL"), "geographic_scope": F.lit("International"),
        "affected_countries": F.array().cast("array<string>"), "id": F.col("event_id"),
    })


def _named(spark, sf):
    return c.directory(spark, sf).withColumnRenamed("country_name", "name")


_STORY5 = f"""{s.STORIES}, top5 AS (SELECT 'e-' || publisher_name || '-' || language AS event_id, id, title, published_at,
   row_number() OVER (PARTITION BY publisher_name, language ORDER BY published_at DESC, id) AS k FROM art QUALIFY k <= 5),
 story_text AS (SELECT event_id, any_value(headline) || ' ' || string_agg(title, ' ' ORDER BY k) AS text FROM top5 JOIN stories USING (event_id) GROUP BY event_id)"""
_FOUND = f"""{_STORY5}, {s.DIRECTORY}, m AS {s.mentions('story_text', 'event_id', 'text')},
 found AS (SELECT event_id, list(coalesce(iso2, country_name) ORDER BY ord) AS ac FROM m JOIN directory ON country_name = country GROUP BY 1)"""


@case("join_event_countries", f"""{ART}, {_FOUND}, e AS (SELECT st.* EXCLUDE (affected_country_count, corroboration, reporting_momentum, freshness, geographic_reach, importance_score, importance_label),
   coalesce(ac, []) AS ac, greatest(1, len(coalesce(ac, []))) AS affected_country_count FROM stories st LEFT JOIN found USING (event_id))
 SELECT event_id, array_to_string(ac, ',') AS affected, affected_country_count::BIGINT AS affected_country_count, importance_score,
   CASE WHEN len(ac) > 1 THEN 'International' ELSE 'International' END AS geographic_scope, CASE WHEN len(ac) > 0 THEN ac[1] ELSE 'GLOBAL' END AS primary_country FROM {s.scored('e')}""")
def event_countries(spark, sf):
    e = co.detect_event_countries(_story_events(spark, sf), c.gazetteer(spark), _named(spark, sf), key="event_id", longest=c.LONGEST)
    return e.select("event_id", F.array_join("affected_countries", ",").alias("affected"),
                    F.col("affected_country_count").cast("long").alias("affected_country_count"), "importance_score", "geographic_scope", "primary_country")


_ALIASES = [("NATION_3", "NATION_17"), ("NATION_9", "Unknown Land")]
_LANGS = [("C0", "fr"), ("C17", "de"), ("C9", "es")]


@case("join_country_codes", f"""WITH {s.DIRECTORY}, al(name, canonical) AS (SELECT * FROM {s.values(_ALIASES, 'name, canonical')}),
 la(iso2, language) AS (SELECT * FROM {s.values(_LANGS, 'iso2, language')}),
 x AS (SELECT c_custkey, 'NATION_' || c_nationkey AS name FROM customer),
 y AS (SELECT x.*, coalesce(d1.iso2, d2.iso2) AS country_code FROM x LEFT JOIN al ON al.name = x.name
   LEFT JOIN directory d1 ON d1.country_name = coalesce(al.canonical, x.name) LEFT JOIN directory d2 ON d2.country_name = x.name)
 SELECT c_custkey, y.name, country_code, coalesce(language, 'en') AS language FROM y LEFT JOIN la ON la.iso2 = coalesce(country_code, 'US')""")
def codes(spark, sf):
    names = c.table(spark, sf, "customer").select("c_custkey", F.format_string("NATION_%d", "c_nationkey").alias("name"))
    d = _named(spark, sf).filter("iso2 is not null").select("name", "iso2")
    return co.resolve_country_codes(
        names, d, spark.createDataFrame(_ALIASES, "name string, canonical string"), spark.createDataFrame(_LANGS, "iso2 string, language string")
    ).select("c_custkey", "name", "country_code", "language")


# --- events: filters, pages, documents -----------------------------------------------------
@case("flt_events_interactive", f"""{ART}, {s.STORIES} SELECT event_id FROM stories WHERE category = 'Politics'
 AND last_updated_at >= {s.AS_OF} - INTERVAL 72 HOUR AND (contains(lower(headline), 'th') OR contains(lower(summary), 'th') OR contains(publisher_name, 'th'))""")
def interactive(spark, sf):
    return sv.filter_events(_story_events(spark, sf), c.AS_OF, category="Politics", time_range="3 days", search=" TH ").select("event_id")


@case("flt_events_api", f"""{ART}, {s.STORIES}, {s.BRIDGE} SELECT event_id FROM stories WHERE active AND importance_label = 'Strong'
 AND event_id IN (SELECT event_id FROM bridge WHERE country_code = 'NATION_7') AND (headline ILIKE '%e%n%' OR summary ILIKE '%e%n%')""")
def api(spark, sf):
    return sv.query_events(c.stories(spark, sf), c.story_bridge(spark, sf), country="nation_7", importance="Strong", search="e%n").select("event_id")


_RET = "2024-01-10 20:30:00"


@case("flt_retained_events", f"{ART}, {s.STORIES} SELECT event_id FROM stories WHERE last_updated_at >= TIMESTAMP '{_RET}' - INTERVAL 7 DAY + INTERVAL 5 MINUTE")
def retained(spark, sf):
    return mg.filter_retained_events(c.stories(spark, sf), _RET).select("event_id")


@case("flt_ambiguous_events", f"""{ART}, {_STORY5}, {s.BRIDGE}, both_ AS (SELECT b.event_id, b.country_code AS country_name, t.text || ' ' || coalesce(summary, '') AS text
   FROM bridge b JOIN story_text t USING (event_id) JOIN stories USING (event_id))
 SELECT event_id, country_name FROM both_ WHERE country_name <> 'NATION_3' OR regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])(thanea the|the thanea)([^\\p{{L}}\\p{{N}}]|$)')""")
def ambiguous(spark, sf):
    e = _story_events(spark, sf).join(c.story_bridge(spark, sf).withColumnRenamed("country_code", "country_name"), "event_id")
    over = spark.createDataFrame(c.OVERRIDES, "country string, term string")
    return mg.filter_ambiguous_country_events(e, over, c.gazetteer(spark), key="event_id", longest=c.LONGEST).select("event_id", "country_name")


_ORDERED = "ORDER BY importance_score DESC, last_updated_at DESC, event_id"


@case("top_rank_events", f"{ART}, {s.STORIES} SELECT event_id, importance_score FROM stories {_ORDERED}")
def ranked(spark, sf):
    return sv.rank_events(c.stories(spark, sf)).select("event_id", "importance_score")


@case("top_breaking_events", f"{ART}, {s.STORIES} SELECT event_id FROM stories WHERE importance_score >= 50 ORDER BY last_updated_at DESC, importance_score DESC, event_id LIMIT 10")
def breaking(spark, sf):
    st = c.stories(spark, sf)
    return sv.breaking_events(st.filter("importance_score >= 50"), st.filter("importance_score < 50")).select("event_id")


@case("top_situation_briefing", f"""{ART}, {_STORY5} SELECT event_id, (SELECT arg_min(id, k) FROM top5 t WHERE t.event_id = s.event_id) AS source_id FROM stories s {_ORDERED} LIMIT 12""")
def briefing(spark, sf):
    return sv.situation_briefing(_story_events(spark, sf)).select("event_id", F.col("source.id").alias("source_id"))


@case("top_paginate_events", f"{ART}, {s.STORIES} SELECT event_id FROM stories WHERE active {_ORDERED} LIMIT 20 OFFSET 20")
def page(spark, sf):
    return sv.paginate_events(sv.query_events(c.stories(spark, sf)), 2, 20).select("event_id")


@case("top_scope_caps", f"{ART} SELECT country_name, id FROM art QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY published_at DESC, id) <= 20")
def caps(spark, sf):
    return gr.top_rows(c.articles(spark, sf), ["country_name"], [gr.newest("published_at"), F.col("id")], 20).select("country_name", "id")


@case("agg_count_events", f"{ART}, {s.STORIES} SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM stories WHERE active")
def counted(spark, sf):
    return sv.count_events(sv.query_events(c.stories(spark, sf)), 20)


@case("join_events_by_country", f"{ART}, {s.STORIES}, {s.BRIDGE} SELECT event_id, country_code, importance_score FROM stories JOIN bridge USING (event_id)")
def by_country(spark, sf):
    d = c.directory(spark, sf).select(F.col("country_name").alias("country_code"), "map_id")
    return sv.events_by_country(c.stories(spark, sf), c.story_bridge(spark, sf), d).select("event_id", "country_code", "importance_score")


def _doc_parts(spark, sf):
    a = c.articles(spark, sf).select(
        F.concat_ws("-", F.lit("e"), "publisher_name", "language").alias("event_id"), "id", F.col("title").alias("headline"),
        F.col("url").alias("original_url"), F.col("publisher_name").alias("source_id"), "published_at",
    )
    src = c.articles(spark, sf).groupBy(F.col("publisher_name").alias("source_id")).agg(
        F.first("publisher_name").alias("publisher_name"), F.concat(F.lit("https://"), F.first("publisher_name")).alias("source_url"),
        F.lit(58.0).alias("prominence_score"),
    )
    return a, src


@case("agg_event_documents", f"""{ART}, {s.STORIES}, {s.BRIDGE}
 SELECT event_id, (SELECT string_agg(country_code, ',' ORDER BY country_code) FROM bridge b WHERE b.event_id = s.event_id) AS countries,
   (SELECT string_agg(id || '@' || a.publisher_name, ',' ORDER BY published_at DESC, id DESC) FROM art a WHERE a.publisher_name = s.publisher_name AND a.language = s.language) AS articles FROM stories s""")
def documents(spark, sf):
    a, src = _doc_parts(spark, sf)
    d = sv.assemble_event_documents(c.stories(spark, sf), c.story_bridge(spark, sf), a, src)
    return d.select(
        "event_id", F.array_join("affected_countries", ",").alias("countries"),
        F.array_join(F.transform("articles", lambda x: F.concat(x["id"], F.lit("@"), x["source"]["publisher_name"])), ",").alias("articles"),
    )


@case("agg_event_pages", f"""{ART}, {s.STORIES}, x AS (SELECT event_id, a.id, row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC, a.id DESC) AS pos, count(*) OVER (PARTITION BY event_id) AS total
   FROM stories s JOIN art a ON a.publisher_name = s.publisher_name AND a.language = s.language)
 SELECT event_id, (pos - 1) // 5 AS page, any_value(total) AS total, string_agg(id, ',' ORDER BY pos) AS articles FROM x GROUP BY 1, 2""")
def document_pages(spark, sf):
    a, src = _doc_parts(spark, sf)
    d = sv.event_document_pages(c.stories(spark, sf), c.story_bridge(spark, sf), a, src, page_rows=5)
    return d.select("event_id", "page", "total", F.array_join(F.transform("articles", lambda x: x["id"]), ",").alias("articles"))


# --- feeds --------------------------------------------------------------------------------
@case("rank_top_event_per_country", f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.DIRECTORY}
 SELECT country_name, event_id, importance_score FROM directory LEFT JOIN (SELECT * FROM bridge JOIN stories USING (event_id) WHERE active
   QUALIFY row_number() OVER (PARTITION BY country_code {_ORDERED}) = 1) ON country_code = country_name""")
def top_event(spark, sf):
    b = c.story_bridge(spark, sf).withColumnRenamed("country_code", "country_name")
    return fd.top_event_per_country(c.directory(spark, sf), b, c.stories(spark, sf), "country_name").select("country_name", "event_id", "importance_score")


def _country_stories(spark, sf):
    return c.stories(spark, sf).join(c.story_bridge(spark, sf).withColumnRenamed("country_code", "country_name"), "event_id")


@case("rank_latest_events", f"""{ART}, {s.STORIES}, {s.BRIDGE} SELECT country_code AS country_name, event_id FROM stories JOIN bridge USING (event_id)
 QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY last_updated_at DESC, importance_score DESC, event_id) <= 20""")
def latest_events(spark, sf):
    return fd.latest_events_per_country(_country_stories(spark, sf)).select("country_name", "event_id")


@case("rank_latest_feed_source", """WITH l AS (SELECT user_id, max(ts) FILTER (value > 20) AS t FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
 r AS (SELECT user_id, max(ts) FILTER (value > 20) AS t FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY 1)
 SELECT 'u' || user_id AS country_name, CASE WHEN r.user_id IS NULL OR (l.user_id IS NOT NULL AND coalesce(l.t, TIMESTAMP '1900-01-01') >= coalesce(r.t, TIMESTAMP '1900-01-01')) THEN 'left' ELSE 'right' END AS fresh_side
 FROM l FULL JOIN r USING (user_id)""")
def feed_source(spark, sf):
    e = c.table(spark, sf, "events")

    def side(*types):
        t = F.max(F.when(F.col("value") > 20, F.col("ts").cast("timestamp"))).alias("updated_at")
        return e.filter(F.col("event_type").isin(*types)).groupBy(F.format_string("u%d", "user_id").alias("country_name")).agg(t)

    return mg.latest_feed_source(side("view", "click"), side("signup", "error", "purchase")).select("country_name", "fresh_side")


@case("join_complete_feeds", f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.WIDE},
 k AS (SELECT * FROM stories JOIN bridge USING (event_id))
 SELECT country_name, coalesce(string_agg(event_id, ',' {_ORDERED}), '') AS events FROM directory LEFT JOIN k ON country_code = country_name GROUP BY 1""")
def complete(spark, sf):
    e = _country_stories(spark, sf)
    return fd.complete_country_feeds(c.wide_directory(spark, sf).select("country_name"), e, c.AS_OF).select(
        "country_name", F.array_join(F.transform("events", lambda x: x["event_id"]), ",").alias("events")
    )


_PAGE = 7


@case("join_complete_pages", f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.WIDE},
 k AS (SELECT *, row_number() OVER (PARTITION BY country_code {_ORDERED}) AS pos, count(*) OVER (PARTITION BY country_code) AS total FROM stories JOIN bridge USING (event_id))
 SELECT country_name, coalesce((pos - 1) // {_PAGE}, 0) AS page, coalesce(any_value(total), 0) AS total, greatest(1, coalesce(ceil(any_value(total) / {_PAGE}), 0))::BIGINT AS n_pages,
   coalesce(string_agg(event_id, ',' ORDER BY pos), '') AS events FROM directory LEFT JOIN k ON country_code = country_name GROUP BY 1, 2""")
def complete_pages(spark, sf):
    pages = fd.complete_country_pages(c.wide_directory(spark, sf).select("country_name"), _country_stories(spark, sf), c.AS_OF, page_rows=_PAGE)
    return pages.select("country_name", "page", "total", "n_pages", F.array_join(F.transform("items", lambda x: x["event_id"]), ",").alias("events"))


@case("join_global_events", f"""{ART}, {_FOUND}, x AS (SELECT event_id, unnest(ac) AS ident FROM found)
 SELECT event_id, country_name FROM x JOIN directory ON ident = iso2 OR ident = country_name""")
def attach(spark, sf):
    e = co.detect_event_countries(_story_events(spark, sf), c.gazetteer(spark), _named(spark, sf), key="event_id", longest=c.LONGEST)
    return fd.attach_global_events(e, c.directory(spark, sf).select("country_name", "iso2")).select("event_id", "country_name")


_EMPTY = "(" + ", ".join(s.q(x) for x in c.EMPTY) + ")"


@case("join_missing_coverage", f"{ART}, {s.WIDE} SELECT country_name FROM directory WHERE country_name NOT IN (SELECT country_name FROM art) AND country_name NOT IN {_EMPTY}")
def missing(spark, sf):
    return fd.missing_coverage(c.wide_directory(spark, sf), c.articles(spark, sf), c.EMPTY).select("country_name")


def _attempts(spark, sf):
    return c.table(spark, sf, "orders").join(c.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.format_string("NATION_%d", "c_nationkey").alias("country_name")
    ).agg(F.max("o_orderdate").cast("timestamp").alias("last_attempt_at"))


_ATT = "att AS (SELECT 'NATION_' || c_nationkey AS country_name, max(o_orderdate)::TIMESTAMP AS last_attempt_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


@case("agg_collection_progress", f"""{ART}, {s.WIDE}, {_ATT} SELECT count(*) FILTER (country_name IN (SELECT country_name FROM att)) AS attempted_countries,
 count(*) FILTER (country_name IN (SELECT country_name FROM art)) AS countries_with_news, count(*) AS total_countries, false AS ready FROM directory""")
def progress(spark, sf):
    return fd.collection_progress(c.wide_directory(spark, sf), _attempts(spark, sf), c.articles(spark, sf), c.articles(spark, sf))


@case("agg_coverage_diagnostics", f"""{ART}, {s.WIDE}, {_ATT} SELECT 'degraded' AS status, count(*) AS total_countries,
 count(*) FILTER (country_name NOT IN {_EMPTY}) AS inhabited_countries,
 string_agg(country_name, ',' ORDER BY country_name) FILTER (country_name NOT IN {_EMPTY} AND country_name NOT IN (SELECT country_name FROM art)) AS missing,
 string_agg(country_name, ',' ORDER BY country_name) FILTER (country_name IN {_EMPTY}) AS expected, (SELECT count(*) FROM art) AS global_event_count FROM directory""")
def diagnostics(spark, sf):
    d = fd.coverage_diagnostics(c.wide_directory(spark, sf), _attempts(spark, sf), c.articles(spark, sf), c.articles(spark, sf), c.EMPTY)
    return d.select(
        "status", "total_countries", F.col("inhabited_countries").cast("long").alias("inhabited_countries"),
        F.array_join("missing_inhabited_countries", ",").alias("missing"), F.array_join("expected_empty_countries", ",").alias("expected"), "global_event_count",
    )


_RUNS = """runs AS (SELECT 'NATION_' || (user_id % 25) AS country_name, event_type AS feed_name, CASE WHEN value < 5 THEN 1 ELSE 2 END AS run_no,
   count(*) FILTER (value > 4.5) AS article_count FROM events GROUP BY ALL)"""


@case("agg_richer_run", f"""WITH {_RUNS}, t AS (SELECT country_name, sum(article_count) AS total FROM runs WHERE run_no = 1 GROUP BY 1)
 SELECT country_name, feed_name, run_no, article_count FROM runs LEFT JOIN t USING (country_name) WHERE run_no = 1 OR coalesce(total, 0) < 30
 QUALIFY row_number() OVER (PARTITION BY country_name, feed_name ORDER BY article_count DESC, run_no) = 1""")
def richer(spark, sf):
    runs = c.table(spark, sf, "events").groupBy(
        F.format_string("NATION_%d", F.col("user_id") % 25).alias("country_name"), F.col("event_type").alias("feed_name"),
        F.when(F.col("value") < 5, 1).otherwise(2).alias("run_no"),
    ).agg(F.count_if(F.col("value") > 4.5).alias("article_count"))
    return fd.richer_of_two_runs(runs, 30).select("country_name", "feed_name", "run_no", "article_count")


@case("agg_viewpoint_retry", """WITH a AS (SELECT 'u' || user_id AS feed_name, bool_or(value > 60) AS ok, count(*) FILTER (value > 60) AS n FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1),
 b AS (SELECT 'u' || user_id AS feed_name, bool_or(value > 50) AS ok, count(*) FILTER (value > 50) AS n FROM events WHERE event_type NOT IN ('view', 'signup') GROUP BY 1)
 SELECT a.feed_name, CASE WHEN b.feed_name IS NOT NULL AND a.n = 0 AND (b.n > 0 OR NOT a.ok) THEN b.ok ELSE a.ok END AS ok,
   CASE WHEN b.feed_name IS NOT NULL AND a.n = 0 AND (b.n > 0 OR NOT a.ok) THEN b.n ELSE a.n END AS article_count FROM a LEFT JOIN b USING (feed_name)""")
def viewpoint(spark, sf):
    e = c.table(spark, sf, "events")

    def run(first, limit):
        kind = F.col("event_type").isin("view", "signup")
        return e.filter(kind if first else ~kind).groupBy(F.format_string("u%d", "user_id").alias("feed_name")).agg(
            F.bool_or(F.col("value") > limit).alias("ok"), F.count_if(F.col("value") > limit).alias("article_count")
        )

    return fd.replace_empty_viewpoints(run(True, 60), run(False, 50))


@case("agg_audit_world_feed", f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.WIDE}, news AS (SELECT * FROM art UNION ALL (SELECT * REPLACE ('EMPTY_2' AS country_name) FROM art ORDER BY doc_id LIMIT 1)),
 te AS (SELECT country_code, last_updated_at FROM bridge JOIN stories USING (event_id) QUALIFY row_number() OVER (PARTITION BY country_code {_ORDERED}) = 1),
 per AS (SELECT country_name, count(*) AS n, count(*) FILTER (url LIKE '%n4%') AS bad FROM news GROUP BY 1),
 r AS (SELECT d.country_name, d.ord > 0 AS present, coalesce(n, 0) > 0 AS has, bad, last_updated_at FROM directory d LEFT JOIN per USING (country_name) LEFT JOIN te ON country_code = d.country_name)
 SELECT country_name, 'missing from complete world response' AS failure FROM r WHERE NOT present
 UNION ALL SELECT country_name, 'inhabited country has no live news' FROM r WHERE present AND NOT has AND country_name NOT IN {_EMPTY}
 UNION ALL SELECT country_name, 'expected-empty country has news' FROM r WHERE has AND country_name IN {_EMPTY}
 UNION ALL SELECT country_name, 'articles did not produce an event' FROM r WHERE has AND last_updated_at IS NULL
 UNION ALL SELECT country_name, 'top event is stale' FROM r WHERE has AND last_updated_at < TIMESTAMP '2024-01-11 18:00:00' - INTERVAL 8 DAY
 UNION ALL SELECT country_name, 'invalid article metadata' FROM r WHERE has AND bad > 0
 UNION ALL SELECT NULL, 'complete world feed is more than two minutes old'""")
def audit(spark, sf):
    d, a = c.wide_directory(spark, sf), c.articles(spark, sf)
    news = a.unionByName(a.orderBy("doc_id").limit(1).withColumn("country_name", F.lit("EMPTY_2"))).withColumn("url", F.when(F.col("url").contains("n4"), "ftp://x").otherwise(F.col("url")))
    ev_ = _country_stories(spark, sf)
    top = gr.first_row(ev_.select("country_name", "event_id", "category", "importance_score", "last_updated_at"), ["country_name"],
                       [gr.highest("importance_score"), gr.newest("last_updated_at"), F.col("event_id")])
    feeds = d.filter("ord > 0").select("country_name", ts("2024-01-11 17:00:00").alias("generated_at"))
    return fd.audit_world_feed(d, feeds, news, top, "2024-01-11 18:00:00", c.EMPTY)


@case("top_stalest_countries", f"WITH {s.WIDE}, {_ATT} SELECT country_name, epoch_us(coalesce(last_attempt_at, TIMESTAMP '1970-01-01')) AS last_attempt_at_us FROM directory LEFT JOIN att USING (country_name)")
def stalest(spark, sf):
    return fd.stalest_countries(c.wide_directory(spark, sf), _attempts(spark, sf)).select("country_name", us("last_attempt_at"))


_CUR = f"""{ART}, cand AS (SELECT *, CASE WHEN feed_name = 'view' THEN 0 ELSE 1 END AS side FROM art WHERE published_at <= {s.AS_OF} AND NOT {s.non_event('title')})"""


@case("dedup_country_feed", f"""{_CUR} SELECT country_name, url AS article_key, id FROM cand
 QUALIFY row_number() OVER (PARTITION BY country_name, url ORDER BY side, published_at DESC, id) = 1""")
def country_feed(spark, sf):
    a = c.articles(spark, sf)
    m = fd.merge_country_feed(a.filter("feed_name = 'view'"), a.filter("feed_name <> 'view'"), c.AS_OF)
    return m.select("country_name", "article_key", "id")


@case("rank_diverse_articles", f"""{ART}, {_STORY5}, {s.BRIDGE}, n AS (SELECT country_name, count(*) AS n FROM art GROUP BY 1),
 er AS (SELECT country_code AS country_name, event_id, row_number() OVER (PARTITION BY country_code {_ORDERED}) AS event_rank FROM stories JOIN bridge USING (event_id)),
 p AS (SELECT er.country_name, event_rank, k AS depth, t.id, a.url FROM er JOIN top5 t USING (event_id) JOIN art a ON a.id = t.id AND a.country_name = er.country_name JOIN n ON n.country_name = er.country_name AND n > 20),
 one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY country_name, url ORDER BY depth, event_rank) = 1)
 SELECT country_name, id FROM one QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY depth, event_rank) <= 20
 UNION ALL SELECT art.country_name, id FROM art JOIN n USING (country_name) WHERE n <= 20""")
def diverse(spark, sf):
    e = _story_events(spark, sf).join(c.story_bridge(spark, sf).withColumnRenamed("country_code", "country_name"), "event_id").withColumn("cluster_id", F.col("event_id"))
    return fd.diverse_articles(c.articles(spark, sf), e).select("country_name", "id")


@case("set_union_feeds", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations")
def union(spark, sf):
    from newsloom.sources.feeds import union_feeds

    t = lambda n, k: c.table(spark, sf, n).select(F.col(k).alias("id"), "text")
    return union_feeds(t("documents", "doc_id"), t("benchmark", "item_id"), t("conversations", "conv_id"))


# --- merging ------------------------------------------------------------------------------
def _merge_input(spark, sf):
    return _story_events(spark, sf).withColumns({
        "grp": F.col("publisher_name"), "feed_ord": F.row_number().over(gr.Window.partitionBy("publisher_name").orderBy("language")).cast("long"),
        "affected_countries": F.array(F.lit("GLOBAL"), F.concat(F.lit("X"), "language")),
    })


@case("agg_merge_events", f"""{ART}, {s.STORIES}, e AS (SELECT *, CASE WHEN article_count <= 1 THEN 0.0::DOUBLE ELSE greatest(1.0::DOUBLE / 60, {s.hours('last_updated_at', 'first_seen_at')}) END AS win FROM stories),
 m AS (SELECT publisher_name AS grp, arg_min(event_id, language) AS id, greatest(max(independent_source_count), 1) AS independent_source_count, count(*) AS affected_country_count,
   min(age_hours) AS age_hours, max(article_count) AS article_count, max(articles_per_hour) AS articles_per_hour, max(win) AS win, min(first_seen_at) AS lo, max(last_updated_at) AS hi,
   string_agg('X' || language, ',' ORDER BY language) AS affected FROM e GROUP BY 1)
 SELECT grp, id, independent_source_count, article_count, round(age_hours, 6) AS age_hours, round(articles_per_hour, 6) AS articles_per_hour, round(win, 6) AS coverage_window_hours,
   epoch_us(lo) AS first_seen_at_us, epoch_us(hi) AS last_updated_at_us, affected, importance_score FROM {s.scored('m')}""")
def merged(spark, sf):
    m = mg.merge_events(_merge_input(spark, sf), "grp")
    return m.select(
        "grp", "id", F.col("independent_source_count").cast("long").alias("independent_source_count"), "article_count",
        *[F.round(n, 6).alias(n) for n in ("age_hours", "articles_per_hour", "coverage_window_hours")],
        us("first_seen_at"), us("last_updated_at"), F.array_join("affected_countries", ",").alias("affected"), "importance_score",
    )


@case("agg_event_geography", f"""{ART}, {s.STORIES}, {s.BRIDGE}, u AS (SELECT event_id, list(country_code ORDER BY country_code) AS l FROM bridge GROUP BY 1),
 e AS (SELECT stories.* EXCLUDE (affected_country_count, corroboration, reporting_momentum, freshness, geographic_reach, importance_score, importance_label), l, len(l) AS affected_country_count FROM stories JOIN u USING (event_id))
 SELECT event_id, array_to_string(l, ',') AS affected, l[1] AS primary_country, importance_score FROM {s.scored('e')}""")
def geography(spark, sf):
    m = c.story_bridge(spark, sf).select(F.col("event_id").alias("id"), F.array("country_code").alias("affected_countries"))
    g = mg.union_event_geography(_story_events(spark, sf), m)
    return g.select("event_id", F.array_join("affected_countries", ",").alias("affected"), "primary_country", "importance_score")


def _event_feed(spark, sf):
    """Every article as a one-article event, in the order of its document."""
    a = ev.with_publisher(cl.classify_headlines(c.articles(spark, sf), c.LEX)).withColumns({
        "headline": F.col("title"), "image_url": F.lit(None).cast("string"), "publisher_url": F.lit(None).cast("string"),
    })
    e = a.select(
        F.concat(F.lit("live-event-"), tx.stable_id(F.lower("title"))).alias("id"), F.col("doc_id").alias("feed_ord"), "headline", "category",
        F.col("description").alias("summary"), F.array(ev.article_struct()).alias("articles"), "feed_name", "country_name",
        F.col("published_at").alias("first_seen_at"), F.col("published_at").alias("last_updated_at"),
        F.lit(1).alias("independent_source_count"), F.lit(1).alias("affected_country_count"), F.lit(1).alias("article_count"),
        F.lit(0.0).alias("coverage_window_hours"), F.lit(0.0).alias("articles_per_hour"),
        ev.hours_between(ts(c.AS_OF), F.col("published_at")).alias("age_hours"),
        F.lit("GLOBAL").alias("primary_country"), F.lit("International").alias("geographic_scope"), F.array().cast("array<string>").alias("affected_countries"),
    )
    return cut(ev.score_events(e))


def _same_sql(order: str = "doc_id", scope: str = "''") -> str:
    """CTEs ev (one-article events), pair(a, b): positions of events of one occurrence."""
    phr = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    step = s.classify(s.tokens("art", "title", "tk"), "title", "tk", "category")
    return f"""ev AS MATERIALIZED (SELECT *, {order} AS o, {scope} AS sc, list_sort(tk) AS full_t, {s.identity('tk')} AS t, 'live-event-' || {s.stable_id('lower(title)')} AS eid FROM {step}),
 po AS MATERIALIZED (SELECT o, sc, unnest(t) AS tok FROM ev),
 me AS MATERIALIZED (SELECT a.o AS a, b.o AS b, count(*) AS n, count(*) FILTER (length(a.tok) >= 7) AS longs FROM po a JOIN po b ON a.tok = b.tok AND a.sc = b.sc AND a.o < b.o GROUP BY ALL HAVING count(*) >= 2),
 wi AS (SELECT a, b, n, longs, {s.containment('n', 'x.t', 'y.t')} AS cont, list_has_any({phr.format('x.t')}, {phr.format('y.t')}) AS phrase,
   x.category = y.category OR len(list_intersect(x.full_t, y.full_t)) >= 4 AS fits, abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= 345600000000 AS near
   FROM me JOIN ev x ON x.o = a JOIN ev y ON y.o = b),
 pair AS MATERIALIZED (SELECT a, b FROM wi WHERE near AND fits AND ((n >= 3 AND (phrase OR cont >= 0.38)) OR (longs >= 2 AND cont >= 0.3) OR (n >= 5 AND cont >= 0.24))
   UNION SELECT a, b FROM (SELECT lag(o) OVER (PARTITION BY sc, full_t ORDER BY o) AS a, o AS b FROM ev WHERE len(full_t) > 0) WHERE a IS NOT NULL)"""


def _fold_sql(order: str = "doc_id", scope: str = "''") -> str:
    """_same_sql + fold(o, f) and merged(f, eid, ...): the folded feed."""
    return f"""{_same_sql(order, scope)},
 eg AS MATERIALIZED (SELECT * FROM pair UNION SELECT a, b FROM (SELECT lag(o) OVER (PARTITION BY sc, eid ORDER BY o) AS a, o AS b FROM ev) WHERE a IS NOT NULL),
 sd AS (SELECT o FROM ev WHERE o NOT IN (SELECT b FROM eg)),
 re AS (SELECT o AS f, o AS n FROM sd UNION SELECT re.f, eg.b FROM re JOIN eg ON eg.a = re.n),
 fold AS MATERIALIZED (SELECT n AS o, min(f) AS f FROM re GROUP BY n),
 lp AS (SELECT f, publisher_name, max(published_at) AS p FROM ev JOIN fold USING (o) GROUP BY ALL),
 sp AS (SELECT f, count(*) AS n, min(p) AS lo, max(p) AS hi FROM lp GROUP BY 1),
 ag AS (SELECT f, min({s.hours(s.AS_OF, 'published_at')}) AS age_hours, max(published_at) AS last_updated_at, string_agg(title, ' ') AS titles FROM ev JOIN fold USING (o) GROUP BY 1),
 mm AS (SELECT f, ev.eid, ev.sc, titles, last_updated_at, age_hours, n AS independent_source_count, n AS article_count, 1 AS affected_country_count,
   CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE (n - 1) / greatest(1.0::DOUBLE / 60, {s.hours('hi', 'lo')}) END AS articles_per_hour FROM ag JOIN sp USING (f) JOIN ev ON ev.o = f),
 merged AS (SELECT * FROM {s.scored('mm')})"""


@case("join_same_occurrence", f"{ART}, {_same_sql()} SELECT a AS left_doc, b AS right_doc FROM pair")
def same_occurrence(spark, sf):
    return mg.same_occurrence_pairs(_event_feed(spark, sf), key="feed_ord").select(F.col("a").alias("left_doc"), F.col("b").alias("right_doc"))


_REC = ART.replace("WITH ", "WITH RECURSIVE ", 1)


@case("dedup_event_feeds", f"{_REC}, {_fold_sql()} SELECT f AS feed_ord, eid AS id, importance_score, independent_source_count, article_count FROM merged")
def event_feeds(spark, sf):
    m = mg.merge_event_feeds(_event_feed(spark, sf))
    return m.select("feed_ord", "id", "importance_score", "independent_source_count", "article_count")


_REG = "(CASE WHEN feed_name = 'view' THEN 0 ELSE (SELECT max(doc_id) + 1 FROM art WHERE feed_name = 'view') END) + doc_id"


@case("dedup_event_registry", f"""{_REC}, {_same_sql(_REG)},
 mt AS MATERIALIZED (SELECT a, b FROM pair UNION SELECT x.o, y.o FROM ev x JOIN ev y ON x.full_t = y.full_t AND len(x.full_t) > 0 AND x.o < y.o UNION SELECT x.o, y.o FROM ev x JOIN ev y ON x.eid = y.eid AND x.o < y.o),
 eg AS MATERIALIZED (SELECT a, b FROM mt JOIN ev ON ev.o = b WHERE feed_name <> 'view'),
 sd AS (SELECT o FROM ev WHERE o NOT IN (SELECT b FROM eg)),
 re AS (SELECT o AS f, o AS n FROM sd UNION SELECT re.f, eg.b FROM re JOIN eg ON eg.a = re.n),
 mb AS MATERIALIZED (SELECT n AS o, min(f) AS f FROM re GROUP BY n UNION SELECT y.o, x.o FROM mt JOIN ev x ON x.o = a JOIN ev y ON y.o = b
   WHERE x.feed_name = 'view' AND y.feed_name <> 'view' AND x.country_name = y.country_name),
 lp AS (SELECT f, publisher_name, max(published_at) AS p FROM ev JOIN mb USING (o) GROUP BY ALL),
 sp AS (SELECT f, count(*) AS n, min(p) AS lo, max(p) AS hi FROM lp GROUP BY 1),
 ag AS (SELECT f, min({s.hours(s.AS_OF, 'published_at')}) AS age_hours FROM ev JOIN mb USING (o) GROUP BY 1),
 mm AS (SELECT f, ev.eid, feed_name, age_hours, n AS independent_source_count, n AS article_count, 1 AS affected_country_count,
   CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE (n - 1) / greatest(1.0::DOUBLE / 60, {s.hours('hi', 'lo')}) END AS articles_per_hour FROM ag JOIN sp USING (f) JOIN ev ON ev.o = f)
 SELECT f AS feed_ord, eid AS id, importance_score, article_count, feed_name = 'view' AND row_number() OVER (PARTITION BY eid, feed_name = 'view' ORDER BY f DESC) = 1 AS shown FROM {s.scored('mm')}""")
def registry(spark, sf):
    """Views are the global feed, affecting the country of their article; all else is its country's feed."""
    e = _event_feed(spark, sf)
    seeds = e.filter("feed_name = 'view'").withColumn("affected_countries", F.array("country_name"))
    r = mg.canonical_event_registry(seeds, e.filter("feed_name <> 'view'"))
    return r.select("feed_ord", "id", "importance_score", "article_count", "shown")


_SNAP_AT = "2024-01-09 00:00:00"


@case("dedup_country_snapshots", f"""{_REC}, {_fold_sql("(CASE WHEN feed_name = 'view' THEN 0 ELSE (SELECT max(doc_id) + 1 FROM art WHERE feed_name = 'view') END) + doc_id", "country_name")}
 SELECT sc AS country_name, eid AS id, importance_score, article_count FROM merged WHERE last_updated_at >= TIMESTAMP '{_SNAP_AT}' - INTERVAL 7 DAY
""")
def snapshots(spark, sf):
    """No country has an ambiguous name here; flt_ambiguous_events covers that rule."""
    e = _event_feed(spark, sf)
    over = spark.createDataFrame([("Elsewhere", "elsewhere")], "country string, term string")
    m = mg.merge_country_snapshots(e.filter("feed_name = 'view'"), e.filter("feed_name <> 'view'"), _SNAP_AT, over, c.gazetteer(spark), c.LONGEST)
    return m.select("country_name", "id", "importance_score", "article_count")


_COVER = f"""hl AS (SELECT event_id, row_number() OVER () AS hid, h FROM (SELECT event_id, headline AS h FROM stories UNION SELECT event_id, title FROM top5)),
 ht AS (SELECT event_id, hid, {s.identity('tk')} AS t FROM {s.tokens('hl', 'h', 'tk')}), hx AS (SELECT event_id, hid, len(t) AS n, unnest(t) AS tok FROM ht),
 ax AS (SELECT id, unnest({s.identity('tk')}) AS tok FROM {s.token_set('art', "concat_ws(' ', title, description)", 'tk')}),
 sx AS (SELECT event_id, hid, n, id, count(*) AS s, count(*) FILTER (length(tok) >= 6) AS d FROM hx JOIN ax USING (tok) GROUP BY ALL),
 cov AS (SELECT DISTINCT event_id, id FROM sx WHERE CASE WHEN n <= 4 THEN s >= 3 OR (s >= 2 AND d >= 1 AND s / n::DOUBLE >= 0.66)
   ELSE s >= 4 OR (s >= 3 AND s / n::DOUBLE >= 0.4) OR (s >= 2 AND d >= 1 AND s / n::DOUBLE >= 0.5) END)"""


@case("join_event_coverage", f"{ART}, {_STORY5}, {_COVER} SELECT event_id, id FROM cov")
def coverage(spark, sf):
    return mg.match_event_coverage(_story_events(spark, sf), c.articles(spark, sf), "event_id")


@case("join_enrich_events", f"""{ART}, {_STORY5}, {_COVER},
 pool AS (SELECT event_id, t.published_at, a.publisher_name FROM top5 t JOIN art a USING (id) UNION ALL SELECT event_id, published_at, publisher_name FROM cov JOIN art USING (id)),
 one AS (SELECT event_id, publisher_name, max(published_at) AS published_at FROM pool GROUP BY ALL),
 sp AS (SELECT event_id, count(*) AS n, min(published_at) AS plo, max(published_at) AS phi FROM one GROUP BY 1),
 e AS (SELECT st.event_id, greatest(independent_source_count, n) AS independent_source_count, affected_country_count, least(age_hours, greatest(0.0::DOUBLE, {s.hours(s.AS_OF, 'phi')})) AS age_hours,
   greatest(article_count, n) AS article_count, greatest(articles_per_hour, CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE (n - 1) / greatest(1.0::DOUBLE / 60, {s.hours('phi', 'plo')}) END) AS articles_per_hour FROM stories st JOIN sp USING (event_id))
 SELECT event_id, independent_source_count, article_count, round(age_hours, 6) AS age_hours, round(articles_per_hour, 6) AS articles_per_hour, importance_score FROM {s.scored('e')}""")
def enriched(spark, sf):
    x = mg.enrich_events_with_coverage(_story_events(spark, sf), c.articles(spark, sf), c.AS_OF, c.LEX, "event_id")
    return x.select("event_id", "independent_source_count", "article_count", *[F.round(n, 6).alias(n) for n in ("age_hours", "articles_per_hour")], "importance_score")
