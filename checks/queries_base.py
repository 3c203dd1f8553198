"""Registered queries: filters, classification, dedupe, publishers, clustering, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import corpus as c, sql as s
from newsloom import dims
from newsloom.functions import scoring, text as tx
from newsloom.operators import (
    classify as cl, cluster as cu, dedupe as dd, events as ev, grouping as gr, publishers as pub,
    quality as ql, similarity as sm,
)

CASES: dict = {}
SQL: dict = {}


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def us(column: str):
    return F.unix_micros(column).alias(f"{column}_us")


ART = f"WITH {s.ART}"


# --- filters --------------------------------------------------------------------------
def sql_strip(x: str) -> str:
    y = f"regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"
    for a, b in (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        y = f"replace({y}, {s.q(a)}, {s.q(b)})"
    return f"trim(regexp_replace(trim({y}), '\\s+', ' ', 'g'))"


_PAGE_RAW = """raw AS (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS rt,
  array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' ') AS rd, regexp_replace(url, '^(https?://[^/?#]+)$', '\\1/') AS url FROM pages)"""
_HOST = "regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')"


def _initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(regexp_replace({x}, '[-_]+', ' ', 'g'), ' '), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )


@case("flt_normalize_articles", f"""WITH {_PAGE_RAW},
 n AS (SELECT {sql_strip('rt')} AS title, {sql_strip('rd')} AS description, url,
   {_initcap("string_split(" + _HOST + ", '.')[-2]")} AS publisher_name FROM raw)
 SELECT {s.stable_id('url')} AS id, title, nullif(description, '') AS description, url, publisher_name,
   regexp_extract(url, '^(https?://[^/?#]+)', 1) AS publisher_url, 1704110400000000::BIGINT AS published_at_us
 FROM n WHERE title <> '' AND NOT {s.non_event('title')} AND publisher_name <> ''""")
def normalize(spark, sf):
    raw = c.table(spark, sf, "pages").select(
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), " ").alias("description"),
        "url", F.lit("Independent publisher").alias("publisher_name"), F.lit("Mon, 01 Jan 2024 12:00:00 GMT").alias("published"),
    )
    out = ql.normalize_articles(raw)
    return out.select("id", "title", "description", "url", "publisher_name", "publisher_url", us("published_at"))


_LATER = "2024-01-10 06:00:00"


@case("flt_current", f"""{ART} SELECT id, epoch_us(published_at) AS published_at_us FROM art
 WHERE published_at BETWEEN TIMESTAMP '{_LATER}' - INTERVAL 8 DAY AND TIMESTAMP '{_LATER}' + INTERVAL 6 HOUR
   AND NOT regexp_matches(trim(title), {s.q(s.ERROR_RX)}, 'i')""")
def current(spark, sf):
    return ql.filter_current(c.articles(spark, sf), _LATER).select("id", us("published_at"))


@case("flt_event_titles", f"{ART} SELECT id, title FROM art WHERE NOT {s.non_event('title')}")
def event_titles(spark, sf):
    return ql.filter_event_titles(c.articles(spark, sf)).select("id", "title")


@case("flt_english", f"{ART} SELECT id, language FROM art WHERE {s.english('title')}")
def english(spark, sf):
    return ql.filter_english(c.articles(spark, sf)).select("id", "language")


_GATE = """body AS (SELECT lang AS feed_name, sum(n_chars)::BIGINT AS body_chars FROM documents GROUP BY lang),
 cur AS (SELECT language AS feed_name, count(*) AS n FROM art WHERE published_at <= TIMESTAMP '2024-01-05 00:00:00'
   AND NOT regexp_matches(trim(title), '^(access denied|attention required|error|feed unavailable|no feed access|service unavailable)(\\b|\\s*[|:-])', 'i') GROUP BY 1),
 status AS (SELECT b.feed_name, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'failed' END AS status,
   coalesce(n, 0) AS article_count FROM body b LEFT JOIN cur USING (feed_name))"""


def _gate(spark, sf):
    arts = c.articles(spark, sf).drop("feed_name").withColumnRenamed("language", "feed_name")
    feeds = c.table(spark, sf, "documents").groupBy(F.col("lang").alias("feed_name")).agg(F.sum("n_chars").alias("body_chars"))
    return ql.gate_feeds(feeds, arts, c.AS_OF)


@case("flt_gate_feeds", f"{ART}, {_GATE} SELECT feed_name, status, article_count FROM status")
def gate(spark, sf):
    return _gate(spark, sf)[1]


@case("agg_feed_health", f"""{ART}, {_GATE} SELECT count(*) AS feeds, count(*) FILTER (status = 'ok') AS ok_feeds,
 sum(article_count)::BIGINT AS article_count, count(*) FILTER (status = 'ok') < count(*) AS degraded FROM status""")
def health(spark, sf):
    return ql.feed_health(_gate(spark, sf)[1])


# --- classification and scores ---------------------------------------------------------
_CLASS = s.classify(s.tokens("art", "title", "toks"), "title", "toks", "category")


@case("agg_classify_headlines", f"{ART} SELECT id, category FROM {_CLASS}")
def classify(spark, sf):
    return cl.classify_headlines(c.articles(spark, sf), c.LEX).select("id", "category")


@case("agg_classify_by_table", f"{ART} SELECT id, category FROM {_CLASS}")
def classify_table(spark, sf):
    """The same lexicon as a table, among one term for every order, which no text holds."""
    terms = spark.createDataFrame([(k, t) for k, ts_ in c.LEXICON.items() for t in ts_], "category string, term string")
    orders = c.table(spark, sf, "orders").select(F.lit("Economy").alias("category"), F.format_string("order%d no%d", "o_orderkey", "o_custkey").alias("term"))
    return cl.classify_by_table(c.articles(spark, sf), cl.prepare_lexicon(terms.unionByName(orders))).select("id", "category")


_PARTS = "round(corroboration, 1) AS corroboration, round(reporting_momentum, 1) AS reporting_momentum, round(freshness, 1) AS freshness, round(geographic_reach, 1) AS geographic_reach"


@case("score_events", f"""SELECT l_orderkey, {_PARTS}, importance_score FROM {s.scored(
  "(SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, count(*) AS k, max(l_quantity) AS a, sum(l_discount) * 10 AS r FROM lineitem GROUP BY l_orderkey)", "n", "k", "a", "r")}""")
def score(spark, sf):
    li = c.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct("l_suppkey").alias("independent_source_count"), F.count("*").alias("affected_country_count"),
        F.max("l_quantity").alias("age_hours"), (F.sum("l_discount") * 10).alias("articles_per_hour"),
    )
    x = ev.score_events(li)
    parts = [F.round(f"scoring_components.{n}", 1).alias(n) for n in ("corroboration", "reporting_momentum", "freshness", "geographic_reach")]
    return x.select("l_orderkey", *parts, "importance_score")


@case("score_labels", """SELECT o_orderkey, CASE WHEN x >= 75 THEN 'Very strong' WHEN x >= 55 THEN 'Strong' WHEN x >= 35 THEN 'Building' ELSE 'Early' END AS label
 FROM (SELECT o_orderkey, least(100, greatest(0, floor(o_totalprice / 3000))) AS x FROM orders)""")
def labels(spark, sf):
    return c.table(spark, sf, "orders").select("o_orderkey", scoring.label(F.floor(F.col("o_totalprice") / 3000)).alias("label"))


_CLEAN = f"""{ART}, ok AS (SELECT * FROM art WHERE published_at BETWEEN {s.AS_OF} - INTERVAL 8 DAY AND {s.AS_OF} + INTERVAL 6 HOUR
   AND NOT {s.non_event('title')} AND {s.english('title')})"""


def _scan(order: str, source: str, limit: str = "") -> str:
    """The sequential keep-first scan, one row per step."""
    return f"""seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS i, id, {s.url_key('url')} AS u, {s.title_key('title')} AS t FROM {source}),
 scan AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS us, []::VARCHAR[] AS ts, ''::VARCHAR AS id, false AS keep
   UNION ALL SELECT seq.i, CASE WHEN ok THEN list_append(us, seq.u) ELSE us END, CASE WHEN ok THEN list_append(ts, seq.t) ELSE ts END, seq.id, ok
   FROM (SELECT scan.*, n.i AS ni, NOT (list_contains(us, n.u) OR list_contains(ts, n.t)) AS ok FROM scan JOIN seq n ON n.i = scan.i + 1) z
   JOIN seq ON seq.i = z.ni)"""


_DEDUPED = f"WITH RECURSIVE {_CLEAN[5:]}, {_scan('published_at DESC, id', 'ok')}"


@case("dedup_articles", f"{_DEDUPED} SELECT id FROM scan WHERE keep")
def dedupe(spark, sf):
    from newsloom.plans import world

    return world.current_articles(c.articles(spark, sf), c.AS_OF).select("id")


@case("category_signal", f"""{_DEDUPED},
 one AS (SELECT category, count(DISTINCT publisher_name) AS independent_source_count, count(*) AS article_count,
   min(published_at) AS lo, max(published_at) AS hi FROM {_CLASS} WHERE id IN (SELECT id FROM scan WHERE keep) GROUP BY category),
 x AS (SELECT *, 1 AS affected_country_count, greatest(0.0::DOUBLE, {s.hours(s.AS_OF, 'hi')}) AS age_hours,
   CASE WHEN article_count <= 1 THEN 0.0::DOUBLE ELSE (article_count - 1) / greatest(1.0::DOUBLE / 60, {s.hours('hi', 'lo')}) END AS articles_per_hour FROM one)
 SELECT category, independent_source_count, article_count, importance_score, importance_label FROM {s.scored('x')}""")
def category_signal(spark, sf):
    from newsloom.plans import world

    return world.category_signal(c.articles(spark, sf), c.AS_OF, c.LEX).select(
        "category", "independent_source_count", "article_count", "importance_score", "importance_label"
    )


_FEED_ORD = "CASE feed_name WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"


def _feeds(spark, sf):
    o = F.create_map(*[F.lit(x) for i, n in enumerate(["view", "click", "signup", "error", "purchase"]) for x in (n, i)])
    return c.articles(spark, sf).withColumns({"feed_ord": o[F.col("feed_name")], "feed_pos": F.col("doc_id")})


@case("rank_interleave_feeds", f"""WITH RECURSIVE {s.ART}, f AS (SELECT *, {_FEED_ORD} AS feed_ord FROM art),
 d AS (SELECT *, row_number() OVER (PARTITION BY feed_ord ORDER BY doc_id) AS depth FROM f),
 e AS (SELECT * FROM d WHERE {s.english('title')}), {_scan('depth, feed_ord', 'e')}
 SELECT id, depth FROM scan JOIN d USING (id) WHERE keep""")
def interleave(spark, sf):
    return dd.interleave_feeds(_feeds(spark, sf)).select("id", "depth")


# --- publishers ---------------------------------------------------------------------------
_PROM = f"coalesce((SELECT arg_min(score, ord) FROM {s.values(c.PROMINENCE, 'ord, needle, score')} WHERE contains(publisher_name, needle)), 58)"


def _ratings(spark):
    return spark.createDataFrame(c.RATINGS, "publisher_key string, bucket string, label string")


def _rated(spark, sf):
    a = pub.join_publisher_rating(c.articles(spark, sf), _ratings(spark))
    return a.withColumn("prominence", pub.prominence_of(F.col("publisher_key"), c.PROMINENCE))


_RATED = f"rated AS (SELECT *, {s.rating('publisher_name')} AS bucket, {_PROM} AS prominence FROM art)"


@case("join_publisher_rating", f"{ART}, {_RATED} SELECT id, publisher_name AS publisher_key, bucket FROM rated")
def join_rating(spark, sf):
    return pub.join_publisher_rating(c.articles(spark, sf), _ratings(spark)).select("id", "publisher_key", "bucket")


@case("join_publisher_prominence", f"{ART} SELECT id, {_PROM} AS prominence FROM art")
def join_prominence(spark, sf):
    from newsloom.dims import prominence_table

    return pub.join_publisher_prominence(c.articles(spark, sf), prominence_table(spark, c.PROMINENCE)).select("id", "prominence")


@case("rank_latest_per_publisher", f"{ART} SELECT country_name, publisher_name AS publisher_key, arg_max(id, published_at) AS id FROM art GROUP BY ALL")
def latest_per_publisher(spark, sf):
    a = c.articles(spark, sf).withColumn("publisher_key", tx.publisher_key(F.col("publisher_name")))
    return pub.latest_article_per_publisher(a, ["country_name"]).select("country_name", "publisher_key", "id")


@case("rank_balanced_sources", f"""{ART}, {_RATED},
 b AS (SELECT *, coalesce(bucket, 'unrated') AS bk, row_number() OVER (PARTITION BY country_name ORDER BY prominence DESC, published_at DESC) AS base FROM rated),
 k AS (SELECT *, row_number() OVER (PARTITION BY country_name, bk ORDER BY base) AS inb FROM b),
 t AS (SELECT *, CASE WHEN country_name < 'NATION_2' THEN CASE WHEN bk IN ('left', 'right') AND inb = 1 THEN 0 WHEN bk = 'center' THEN 1 ELSE 2 END ELSE 0 END AS tier FROM k),
 p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY tier, base) <= 5)
 SELECT country_name, id, row_number() OVER (PARTITION BY country_name ORDER BY base) AS rank FROM p""")
def balanced(spark, sf):
    x = pub.balanced_top_sources(_rated(spark, sf), ["country_name"], 5, F.col("country_name") < "NATION_2")
    return x.select("country_name", "id", F.col("rank").cast("long").alias("rank"))


@case("agg_perspective_mix", f"""{ART}, {_RATED},
 one AS (SELECT DISTINCT country_name, publisher_name, coalesce(bucket, 'unrated') AS bucket FROM rated),
 n AS (SELECT country_name, count(*) FILTER (bucket = 'left') AS l, count(*) FILTER (bucket = 'center') AS c,
   count(*) FILTER (bucket = 'right') AS r, count(*) FILTER (bucket = 'unrated') AS u, count(*) AS total FROM one GROUP BY 1),
 long AS (SELECT country_name, total, unnest([l, c, r, u]) AS k, unnest([0, 1, 2, 3]) AS o FROM n),
 f AS (SELECT *, k / total::DOUBLE * 100.0::DOUBLE AS v FROM long),
 g AS (SELECT *, row_number() OVER (PARTITION BY country_name ORDER BY v - floor(v) DESC, o) AS place,
   100 - sum(floor(v)) OVER (PARTITION BY country_name) AS left_over FROM f),
 h AS (SELECT *, (floor(v) + CASE WHEN place <= left_over THEN 1 ELSE 0 END)::INTEGER AS pct FROM g)
 SELECT country_name, max(total) AS total, max(pct) FILTER (o = 0) AS left_pct, max(pct) FILTER (o = 1) AS center_pct,
   max(pct) FILTER (o = 2) AS right_pct, max(pct) FILTER (o = 3) AS unrated_pct FROM h GROUP BY 1""")
def mix(spark, sf):
    return pub.publisher_perspective_mix(_rated(spark, sf), ["country_name"]).select(
        "country_name", "total", "left_pct", "center_pct", "right_pct", "unrated_pct"
    )


# --- similarity, clusters, events ----------------------------------------------------------
@case("join_similar_pairs", f"""WITH {s.ART}, {s.content_pairs()}
 SELECT least(ida, idb) AS left_id, greatest(ida, idb) AS right_id, round(similarity, 9) AS similarity FROM link
 WHERE len(list_filter(ta, lambda x: len(list_filter(tb, lambda y: abs(epoch_us(x) - epoch_us(y)) <= 259200000000)) > 0)) > 0""")
def pairs(spark, sf):
    x = sm.similar_article_pairs(c.articles(spark, sf), c.LEX)
    return x.select("left_id", "right_id", F.round("similarity", 9).alias("similarity"))


_CLUSTERS = f"WITH RECURSIVE {s.ART}, {s.cluster_labels()}"


@case("cluster_articles", f"{_CLUSTERS} SELECT id, cluster_id FROM assigned")
def clusters(spark, sf):
    return cu.cluster_articles(c.articles(spark, sf), c.LEX)[0].select("id", "cluster_id")


_PAIR_TOTAL = """sims AS (SELECT ra, rb FROM sim WHERE similarity > 0 UNION ALL SELECT rb, ra FROM sim WHERE similarity > 0),
 mem AS (SELECT cluster_id, r, count(*) AS n FROM assigned GROUP BY ALL),
 deg AS (SELECT m.cluster_id, m.r, coalesce(sum(o.n), 0) + CASE WHEN m.r IN (SELECT r FROM alike) THEN any_value(m.n) - 1 ELSE 0 END AS links
   FROM mem m LEFT JOIN sims x ON x.ra = m.r LEFT JOIN mem o ON o.cluster_id = m.cluster_id AND o.r = x.rb GROUP BY m.cluster_id, m.r)"""


@case("rank_representative", f"""{_CLUSTERS}, {_PAIR_TOTAL}
 SELECT cluster_id, id FROM (SELECT a.cluster_id, a.id, row_number() OVER (PARTITION BY a.cluster_id
   ORDER BY d.links DESC, {_PROM} DESC, a.published_at DESC, a.id) AS k
   FROM assigned a JOIN deg d USING (cluster_id, r) JOIN art t ON t.id = a.id) WHERE k = 1""")
def representative(spark, sf):
    assigned, reports, similar = cu.cluster_articles(c.articles(spark, sf), c.LEX)
    names = c.articles(spark, sf).select("id", pub.prominence_of(F.col("publisher_name"), c.PROMINENCE).alias("prominence"))
    return cu.representative_articles(assigned.join(names, "id"), reports, similar)


_EVENT_ROWS = f"""ev0 AS (SELECT * FROM art WHERE NOT {s.non_event('title')})"""
_EVENTS = f"""WITH RECURSIVE {s.ART}, {_EVENT_ROWS}, {s.cluster_labels(source='ev0')}, {_PAIR_TOTAL},
 repr AS (SELECT * FROM (SELECT a.cluster_id, t.title AS headline, a.category AS hc, row_number() OVER (PARTITION BY a.cluster_id
   ORDER BY d.links DESC, a.published_at DESC, a.id) AS k FROM assigned a JOIN deg d USING (cluster_id, r) JOIN art t ON t.id = a.id) WHERE k = 1),
 st AS (SELECT cluster_id, count(*) AS article_count, min(a.published_at) AS lo, max(a.published_at) AS hi,
   count(DISTINCT publisher_name) AS independent_source_count FROM assigned a JOIN art USING (id) GROUP BY 1),
 evs AS (SELECT *, 1 AS affected_country_count, greatest(0.0::DOUBLE, {s.hours(s.AS_OF, 'hi')}) AS age_hours,
   CASE WHEN article_count <= 1 THEN 0.0::DOUBLE ELSE greatest(1.0::DOUBLE / 60, {s.hours('hi', 'lo')}) END AS coverage_window_hours,
   CASE WHEN article_count <= 1 THEN 0.0::DOUBLE ELSE (article_count - 1) / greatest(1.0::DOUBLE / 60, {s.hours('hi', 'lo')}) END AS articles_per_hour
   FROM st JOIN repr USING (cluster_id))"""


def _hit_lists(source: str) -> str:
    """Cluster categories from the distinct hits of all member texts."""
    toks = s.token_set(source, "body", "bt")
    names = [k for k in dims.TIE_PRIORITY if k in c.LEXICON]
    cols, sums = [], []
    for i, k in enumerate(names):
        words, phrases = cl._split_terms(tuple(c.LEXICON[k]))
        part = []
        for j, w in enumerate(words):
            cols.append(f"list_contains(bt, {s.q(w)}) AS w{i}_{j}")
            part.append(f"bool_or(w{i}_{j})::INT")
        for j, p in enumerate(phrases):
            rx = "(^|[^\\p{L}\\p{N}])" + p.replace(" ", "\\s+") + "([^\\p{L}\\p{N}]|$)"
            cols.append(f"regexp_matches(lower(body), {s.q(rx)}) AS p{i}_{j}")
            part.append(f"2 * bool_or(p{i}_{j})::INT")
        for cat, name, rx in (
            ("Conflict and security", "strike", "\\b(strikes?|hits?)\\b.{0,90}\\b(base|bases|border|capital|cities|city|military|site|sites|territory)\\b"),
            ("Economy", "tariff", "\\btariffs?\\b"),
        ):
            if k == cat:
                cols.append(f"regexp_matches(lower(body), {s.q(rx)}) AS {name}")
                part.append(f"2 * bool_or({name})::INT")
        sums.append(f"{' + '.join(part)} AS s{i}")
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    return (
        f"SELECT cluster_id, CASE WHEN {best} = 0 THEN 'Local affairs' " + " ".join(f"WHEN s{i} = {best} THEN {s.q(k)}" for i, k in enumerate(names))
        + f" END AS again FROM (SELECT cluster_id, {', '.join(sums)} FROM (SELECT cluster_id, {', '.join(cols)} FROM {toks}) GROUP BY cluster_id)"
    )


_REREAD = f"""bodies AS (SELECT cluster_id, concat_ws(' ', title, description) AS body FROM assigned JOIN art USING (id)
   WHERE cluster_id IN (SELECT cluster_id FROM repr WHERE hc = 'Local affairs')), again AS ({_hit_lists('bodies')})"""


@case("agg_build_events", f"""{_EVENTS}, {_REREAD}
 SELECT 'live-event-' || {s.stable_id('lower(headline)')} AS id, cluster_id, headline, coalesce(again, hc) AS category, importance_score, importance_label,
   independent_source_count, article_count, round(age_hours, 6) AS age_hours, round(coverage_window_hours, 6) AS coverage_window_hours,
   round(articles_per_hour, 6) AS articles_per_hour, epoch_us(lo) AS first_seen_at_us, epoch_us(hi) AS last_updated_at_us
 FROM {s.scored('evs')} LEFT JOIN again USING (cluster_id)""")
def build(spark, sf):
    e = ev.build_events(c.articles(spark, sf), c.AS_OF, c.LEX)
    return e.select(
        "id", "cluster_id", "headline", "category", "importance_score", "importance_label", "independent_source_count",
        "article_count", *[F.round(n, 6).alias(n) for n in ("age_hours", "coverage_window_hours", "articles_per_hour")],
        us("first_seen_at"), us("last_updated_at"),
    )


_FEEDTEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


def sql_truncate(x: str, n: int = 180, floor: int = 80) -> str:
    head = f"left({x}, {n - 1})"
    last = f"CASE WHEN contains({head}, ' ') THEN length({head}) - instr(reverse({head}), ' ') ELSE -1 END"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({head}, greatest({floor}, {last})) || '…' END"


@case("agg_choose_summary", f"""{ART}, h AS (SELECT country_name, arg_min(title, id) AS headline FROM art GROUP BY 1),
 d AS (SELECT country_name, id, published_at, {_FEEDTEXT.format('description')} AS t FROM art),
 k AS (SELECT d.country_name, arg_min(t, ((CASE WHEN regexp_matches(t, '[.!?]$') THEN 0 ELSE 1 END), length(t), -epoch_us(published_at), id)) AS best
   FROM d JOIN h USING (country_name) WHERE length(t) >= 35 AND lower(t) <> lower({_FEEDTEXT.format('headline')})
   AND NOT regexp_matches(t, '^(expanded topic search|current reporting indexed|current reporting from|browse current|open the source|the displayed reports|live coverage)', 'i') GROUP BY 1),
 z AS (SELECT country_name, CASE WHEN best IS NULL THEN regexp_replace({_FEEDTEXT.format('headline')}, '[.!?]+$', '') || '.'
   ELSE coalesce(nullif(trim(regexp_extract(best, '^.*?[.!?](\\s|$)')), ''), best) END AS x FROM h LEFT JOIN k USING (country_name))
 SELECT country_name, {sql_truncate('x')} AS summary FROM z""")
def summary(spark, sf):
    a = c.articles(spark, sf)
    heads = a.groupBy("country_name").agg(F.min_by("title", "id").alias("headline"))
    return ev.choose_summary(a.select("country_name", "description", "published_at", "id"), heads, "country_name")
