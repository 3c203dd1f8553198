"""Registered queries: geometry, streams, sources, sinks, streaming, views."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from checks import corpus as c, sql as s
from checks.queries_base import ART, case, sql_strip, us
from checks.queries_more import _ATT, _attempts, _country_stories, _story_events
from newsloom import dims, schemas
from newsloom.functions import scoring, text as tx
from newsloom.operators import countries as co, feeds as fd, geo, grouping as gr, quality as ql, video as vd
from newsloom.session import checkpoint_dir, cut
from newsloom.sources import feeds as sf_, tables as st


def landing(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land(spark, rows, path: str) -> None:
    """``rows`` as a folder that a watching stream sees at once: written aside, then moved."""
    aside = landing(spark, "aside")
    rows.write.parquet(aside)
    files, at = pafs.FileSystem.from_uri(aside)
    files.move(at, pafs.FileSystem.from_uri(path)[1])


# --- polygons derived from the nation table ---------------------------------------------------
def polygons(spark, sf):
    n = c.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    x0 = F.when(F.col("k") % 5 == 4, 150).otherwise((F.col("k") % 5) * 65 - 178).cast("double")
    y0 = (F.floor(F.col("k") / 5) * 34 - 85).cast("double")
    n = n.withColumns({"x0": x0, "y0": y0})
    wrap = lambda x: F.when(x > 180, x - 360).otherwise(x)

    def box(x, y, w, h):
        pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        return F.array(*[F.struct(wrap(a).alias("lon"), b.alias("lat")) for a, b in pts])

    outer = box(F.col("x0"), F.col("y0"), 60.0, 28.0)
    hole = box(F.col("x0") + 20, F.col("y0") + 8, 20.0, 10.0)
    rings = F.array(F.struct(F.lit(0).alias("ring_id"), outer.alias("ring")), F.when(F.col("k") % 3 == 0, F.struct(F.lit(1).alias("ring_id"), hole.alias("ring"))))
    return n.select(
        F.col("k").alias("ord"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("country_id"), "name",
        F.format_string("p%03d", "k").alias("polygon_id"), F.explode(F.array_compact(rings)).alias("r"),
    ).select("ord", "country_id", "name", "polygon_id", "r.ring_id", "r.ring")


_BOX = """box AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 5 = 4 THEN 150 ELSE (n_nationkey % 5) * 65 - 178 END AS x0,
  floor(n_nationkey / 5) * 34 - 85 AS y0 FROM nation)"""
_PTS = """pts AS (SELECT c_custkey AS id, ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((c_custkey * 53) % 1900) / 10.0::DOUBLE - 95 AS lat FROM customer)"""


def _points(spark, sf):
    k = F.col("c_custkey")
    return c.table(spark, sf, "customer").select(
        k.alias("id"), (((k * 37) % 3600) / 10.0 - 180).alias("lon"), (((k * 53) % 1900) / 10.0 - 95).alias("lat")
    )


@case("join_points_in_polygons", f"""WITH {_BOX}, {_PTS}, hit AS (SELECT id, k, name FROM pts JOIN box ON lat <= 90 AND lat >= -90 AND lat BETWEEN y0 AND y0 + 28
   AND (lon BETWEEN x0 AND x0 + 60 OR lon + 360 BETWEEN x0 AND x0 + 60)
   AND NOT (k % 3 = 0 AND lat > y0 + 8 AND lat < y0 + 18 AND ((lon > x0 + 20 AND lon < x0 + 40) OR (lon + 360 > x0 + 20 AND lon + 360 < x0 + 40))))
 SELECT id, arg_min(name, k) AS name FROM pts LEFT JOIN hit USING (id) GROUP BY id""")
def points(spark, sf):
    return geo.points_in_polygons(_points(spark, sf), geo.prepare_polygons(polygons(spark, sf))).select("id", "name")


@case("agg_polygon_centers", f"""WITH {_BOX} SELECT name, round(CASE WHEN x0 + 30 >= 180 THEN x0 + 30 - 360 ELSE x0 + 30 END::DOUBLE, 6) AS lon, round((y0 + 14)::DOUBLE, 6) AS lat FROM box""")
def centers(spark, sf):
    return geo.polygon_centers(polygons(spark, sf)).select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _capitals(spark, sf):
    n = c.table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    return n.select(
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("C"), F.col("k").cast("string"))).alias("iso2"),
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("I"), F.col("k").cast("string"))).alias("iso3"),
        F.when(F.col("k") == 8, "N/A").otherwise(F.concat(F.lit("cap"), F.col("k").cast("string"))).alias("capital"),
        F.when(F.col("k") == 12, 0.0).otherwise(F.col("k") * 2.0).alias("lat"), F.when(F.col("k") == 12, 0.0).otherwise(F.col("k") * -3.0).alias("lng"),
    )


_CAPS = """caps AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'C' || n_nationkey END AS iso2, CASE WHEN n_nationkey % 4 = 1 THEN 'I' || n_nationkey END AS iso3,
  CASE WHEN n_nationkey = 8 THEN 'N/A' ELSE 'cap' || n_nationkey END AS capital, CASE WHEN n_nationkey = 12 THEN 0.0 ELSE n_nationkey * 2.0 END::DOUBLE AS lat,
  CASE WHEN n_nationkey = 12 THEN 0.0 ELSE n_nationkey * -3.0 END::DOUBLE AS lng FROM nation)"""
_OKCAPS = f"{_CAPS}, okcaps AS (SELECT * FROM caps WHERE capital <> 'N/A' AND NOT (lat = 0 AND lng = 0))"


@case("src_capitals", f"WITH {_OKCAPS} SELECT iso2, iso3, capital, lat, lng FROM okcaps")
def capitals(spark, sf):
    path = landing(spark, "capitals")
    _capitals(spark, sf).write.json(path)
    return st.clean_capitals(spark.read.schema(schemas.CAPITALS).json(path))


def _styled(spark, sf):
    best = gr.first_row(
        _country_stories(spark, sf).select("country_name", "event_id", "category", "importance_score", "last_updated_at"),
        ["country_name"], [gr.highest("importance_score"), gr.newest("last_updated_at"), F.col("event_id")],
    ).select("country_name", "category", "importance_score")
    d = c.wide_directory(spark, sf).join(best, "country_name", "left")
    return d.select(F.col("country_name").alias("name"), "map_id", "ord", "iso2", F.concat(F.lit("I"), F.col("ord").cast("string")).alias("iso3"), "category", "importance_score", (F.col("ord") != 100).alias("signal_ready"))


_TOPS = f"""tops AS (SELECT country_code AS country_name, category, importance_score FROM bridge JOIN stories USING (event_id)
  QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY importance_score DESC, last_updated_at DESC, event_id) = 1)"""
_CENTER = "ctr AS (SELECT name, CASE WHEN x0 + 30 >= 180 THEN x0 + 30 - 360 ELSE x0 + 30 END::DOUBLE AS lon, (y0 + 14)::DOUBLE AS lat FROM box)"


def _mix(cat: str, score: str) -> str:
    parts = []
    for i in (1, 3, 5):
        fg = "CASE " + cat + " " + " ".join(f"WHEN {s.q(k)} THEN {int(v[i:i + 2], 16)}" for k, v in dims.CATEGORY_COLORS.items()) + " END"
        base = int(dims.MAP_BASE_COLOR[i:i + 2], 16)
        amount = f"(0.72::DOUBLE + least(100.0::DOUBLE, greatest(0.0::DOUBLE, {score}::DOUBLE)) * 0.0028::DOUBLE)"
        parts.append(f"lpad(lower(to_hex(floor({fg} * {amount} + (1.0::DOUBLE - {amount}) * {base}.0::DOUBLE + 0.5::DOUBLE)::BIGINT)), 2, '0')")
    return "'#' || " + " || ".join(parts)


@case("join_country_markers", f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.WIDE}, {_TOPS}, {_BOX}, {_OKCAPS}, {_CENTER},
 d AS (SELECT directory.*, 'I' || ord AS iso3, category, importance_score FROM directory LEFT JOIN tops USING (country_name)),
 a AS (SELECT d.country_name, capital, lat, lng FROM d JOIN okcaps o ON o.iso2 = d.iso2), b AS (SELECT d.country_name, capital, lat, lng FROM d JOIN okcaps o ON o.iso3 = d.iso3 WHERE country_name NOT IN (SELECT country_name FROM a)),
 r AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT country_name, country_name, lat, lon FROM d JOIN ctr ON ctr.name = country_name WHERE country_name NOT IN (SELECT country_name FROM a UNION SELECT country_name FROM b))
 SELECT country_name AS name, capital, round(lat, 6) AS lat, round(lng, 6) AS lng, CASE WHEN category IS NULL THEN '#8aa3b2' ELSE {_mix('category', 'importance_score')} END AS color FROM r JOIN d USING (country_name)""")
def markers(spark, sf):
    m = geo.locate_country_markers(_styled(spark, sf), st.clean_capitals(_capitals(spark, sf)), geo.polygon_centers(polygons(spark, sf)))
    return m.select("name", "capital", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "color")


_STYLE = f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.WIDE}, {_TOPS}
 SELECT map_id, country_name AS name, CASE WHEN category IS NOT NULL THEN {_mix('category', 'importance_score')} WHEN ord = 100 THEN '#5b6b78' ELSE '#42657a' END AS color,
   CASE WHEN map_id = 'm3' THEN 0.68 WHEN category IS NOT NULL THEN 0.46 ELSE 0.28 END::DOUBLE AS opacity FROM directory LEFT JOIN tops USING (country_name)"""


def _geometry(spark, sf):
    """One shape per country; those without data have one as well."""
    p = polygons(spark, sf).select("ord", "country_id", "name").distinct()
    empty = c.wide_directory(spark, sf).filter("ord >= 100").select("ord", F.col("map_id").alias("country_id"), F.col("country_name").alias("name"))
    shapes = p.unionByName(empty)
    return shapes.select(F.when(F.col("ord") % 2 == 0, F.col("country_id")).alias("country_id"), F.concat(F.lit(" "), "name").alias("name"))


@case("join_style_countries", _STYLE)
def styled(spark, sf):
    return geo.style_country_table(_geometry(spark, sf), _styled(spark, sf), "m3").select("map_id", "name", "color", "opacity")


@case("view_choropleth", f"""{ART}, {s.STORIES} SELECT event_id, {_mix('category', 'importance_score')} AS color FROM stories""")
def choropleth(spark, sf):
    return c.stories(spark, sf).select("event_id", scoring.fill_color(F.col("category"), F.col("importance_score")).alias("color"))


def _links(spark, sf):
    ctr = geo.polygon_centers(polygons(spark, sf)).select("name", "lon", "lat")
    countries = c.directory(spark, sf).withColumnRenamed("country_name", "name").join(ctr, "name")
    e = c.stories(spark, sf).withColumn("ord", F.col("first_id")).withColumn("primary_country", F.concat(F.lit("NATION_"), F.substring("first_id", -1, 1)))
    m = c.story_bridge(spark, sf).withColumnRenamed("country_code", "country")
    return geo.strongest_country_links(e, m, countries, "m6", 28)


_LINKS = f"""{ART}, {s.STORIES}, {s.BRIDGE}, {s.DIRECTORY}, {_BOX}, {_CENTER},
 me AS (SELECT b.event_id, country_name, map_id, ord, iso2, importance_score, first_id, category, 'NATION_' || right(first_id, 1) AS prim FROM bridge b JOIN directory ON country_name = country_code JOIN stories USING (event_id)),
 o AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM me QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN map_id = 'm6' THEN 0 WHEN coalesce(iso2 = prim, false) OR country_name = prim THEN 1 ELSE 2 END, ord) = 1),
 ed AS (SELECT me.event_id, o.country_name AS f, me.country_name AS t, me.importance_score, me.first_id, me.ord, least(o.country_name, me.country_name) AS p1, greatest(o.country_name, me.country_name) AS p2 FROM me JOIN o USING (event_id) WHERE o.n >= 2 AND me.map_id <> o.map_id),
 links AS (SELECT * FROM (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY p1, p2 ORDER BY importance_score DESC, first_id, ord) = 1) ORDER BY importance_score DESC, first_id, ord LIMIT 28)"""


@case("agg_country_links", f'{_LINKS} SELECT event_id, f AS "from", t AS "to", importance_score FROM links')
def links(spark, sf):
    return _links(spark, sf).select("event_id", "from", "to", "importance_score")


@case("graph_link_paths", f"""{_LINKS}, g AS (SELECT f, t, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM links JOIN ctr a ON a.name = f JOIN ctr b ON b.name = t),
 h AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, (y0 + y1) / 2 AS mid FROM g),
 k AS (SELECT *, least(18.0::DOUBLE, greatest(2.5::DOUBLE, sqrt(pow(dx * cos(mid * (pi() / 180)), 2) + dy * dy) * 0.16::DOUBLE)) AS bend, greatest(0.001::DOUBLE, sqrt(dx * dx + dy * dy)) AS len, CASE WHEN mid >= 0 THEN 1 ELSE -1 END AS side FROM h),
 m AS (SELECT *, (x0 + x1) / 2 - dy / len * bend * side AS cx, (y0 + y1) / 2 + dx / len * bend * side AS cy FROM k),
 p AS (SELECT *, unnest(range(37)) AS i FROM m)
 SELECT f AS "from", t AS "to", i::INTEGER AS step, round(pow(1 - i / 36.0::DOUBLE, 2) * x0 + 2 * (1 - i / 36.0::DOUBLE) * (i / 36.0::DOUBLE) * cx + pow(i / 36.0::DOUBLE, 2) * x1, 5) AS lon,
   round(pow(1 - i / 36.0::DOUBLE, 2) * y0 + 2 * (1 - i / 36.0::DOUBLE) * (i / 36.0::DOUBLE) * cy + pow(i / 36.0::DOUBLE, 2) * y1, 5) AS lat FROM p""")
def paths(spark, sf):
    p = geo.event_link_paths(_links(spark, sf)).select("from", "to", F.posexplode("path").alias("step", "p"))
    return p.select("from", "to", "step", F.round("p.lon", 5).alias("lon"), F.round("p.lat", 5).alias("lat"))


# --- live streams derived from the documents --------------------------------------------------
_ROOMS = dims.NEWSROOMS


def _records(spark, sf):
    a = c.table(spark, sf, "documents")
    simple = lambda x: F.struct(x.alias("simpleText"), F.lit(None).cast("array<struct<text:string>>").alias("runs"))
    runs = lambda x: F.struct(F.lit(None).cast("string").alias("simpleText"), F.array(F.struct(x.alias("text"))).alias("runs"))
    room = F.element_at(tx.lit_array(_ROOMS + ["City Cam Channel"]), (F.substring("source", 4, 2).cast("int") + 1))
    return a.select(
        F.format_string("vid%06d", F.floor(F.col("doc_id") / 2)).alias("videoId"),
        simple(F.col("text")).alias("title"), runs(F.upper(room)).alias("ownerText"),
        simple(F.format_string("%d.5K watching", F.col("n_chars"))).alias("viewCountText"),
        F.when(F.col("lang").isin("en", "de"), F.array(F.struct(F.struct(F.lit(st.LIVE_BADGE).alias("style")).alias("metadataBadgeRenderer")))).alias("badges"),
        F.struct(F.array(
            F.struct(F.lit("http://small").alias("url"), F.lit(10).alias("width"), F.lit(10).alias("height")),
            F.struct(F.concat(F.lit("http://big/"), "lang").alias("url"), F.lit(100).alias("width"), F.lit(90).alias("height")),
        ).alias("thumbnails")).alias("thumbnail"),
        F.col("doc_id").alias("ord"),
    )


_STREAMS = f"""streams AS (SELECT * FROM (SELECT printf('vid%06d', doc_id // 2) AS id, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title,
   upper({s.lst(_ROOMS + ['City Cam Channel'])}[substr(source, 4)::INT + 1]) AS channel_name, floor((n_chars + 0.5) * 1000 + 0.5)::BIGINT AS viewer_count, 'http://big/' || lang AS thumbnail_url
   FROM documents WHERE lang IN ('en', 'de')) WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1)"""


def _streams(spark, sf):
    path = landing(spark, "streams")
    _records(spark, sf).write.json(path)
    rows = spark.read.schema(schemas.STREAM_RECORD + ", ord BIGINT").json(path)
    return st.parse_live_streams(rows)


@case("src_live_streams", f"WITH {_STREAMS} SELECT id, title, channel_name, viewer_count, thumbnail_url FROM streams")
def streams(spark, sf):
    return _streams(spark, sf).select("id", "title", "channel_name", "viewer_count", "thumbnail_url")


@case("src_renderer_search", f"""WITH {_STREAMS.replace("printf('vid%06d', doc_id // 2)", "printf('vid%06d', doc_id)")} SELECT id, title, channel_name, viewer_count, thumbnail_url FROM streams""")
def renderer_search(spark, sf):
    """Records in three nestings: one to a body, many of one source in a list, and deep inside objects and lists."""
    r = _records(spark, sf).withColumn("videoId", F.format_string("vid%06d", "ord"))
    record = F.struct(F.struct(*[x for x in r.columns if x != "ord"]).alias("videoRenderer"))
    k = F.col("ord") % 3
    one = r.filter(k == 0).select("ord", F.to_json(record).alias("body"))
    parts = r.filter(k == 1).select(F.floor(F.col("ord") / 40).alias("g"), "ord", F.to_json(record).alias("r")).groupBy("g").agg(
        F.min("ord").alias("ord"), F.array_join(F.sort_array(F.collect_list("r")), ",").alias("r")
    )
    many = parts.select("ord", F.concat(F.lit('{"kind":"x","contents":['), "r", F.lit("]}")).alias("body"))
    deep = r.filter(k == 2).select("ord", F.to_json(F.struct(F.array(F.array(F.struct(F.struct(F.array(F.lit("no"), F.lit("yes")).alias("plain"), record.alias("b")).alias("a")))).alias("z"), F.lit(1).alias("n"))).alias("body"))
    path = landing(spark, "bodies")
    one.unionByName(many).unionByName(deep).write.parquet(path)
    bodies = spark.read.schema("ord long, body string").parquet(path)
    return st.search_live_streams(bodies).select("id", "title", "channel_name", "viewer_count", "thumbnail_url")


_ROOMSQL = "CASE channel_name " + " ".join(f"WHEN {s.q(n.upper())} THEN {s.q(n)}" for n in _ROOMS) + " END"


@case("join_newsrooms", f"WITH {_STREAMS} SELECT id, {_ROOMSQL} AS newsroom_name FROM streams WHERE {_ROOMSQL} IS NOT NULL")
def newsrooms(spark, sf):
    return vd.match_newsrooms(_streams(spark, sf), vd.newsroom_table(spark)).select("id", "newsroom_name")


@case("agg_newsroom_streams", f"""WITH {_STREAMS}, n AS (SELECT {_ROOMSQL} AS newsroom_name, id, viewer_count FROM streams WHERE {_ROOMSQL} IS NOT NULL)
 SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY newsroom_name ORDER BY viewer_count DESC, id) = 1) ORDER BY viewer_count DESC, newsroom_name LIMIT 12""")
def newsroom_streams(spark, sf):
    cols = "newsroom_name string, id string, title string, channel_name string, viewer_count long"
    verified = spark.createDataFrame([("WION", "verified", "WION live", "WION", 0)], cols)
    return vd.best_stream_per_newsroom(_streams(spark, sf), vd.newsroom_table(spark), verified).select("newsroom_name", "id", "viewer_count")


_HEAD = "The attion that thanedble of eriner and thanea therhean"
_STOKS = "list_filter(list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4)), lambda w: NOT list_contains(" + s.lst(dims.SEARCH_STOP_WORDS).replace("{", "{{") + ", w))"


@case("top_streams_for_headline", f"""WITH {_STREAMS}, r AS (SELECT *, len(list_intersect({_STOKS.format('title')}, {_STOKS.format(s.q(_HEAD))})) AS relevance FROM streams)
 SELECT id, relevance::INTEGER AS relevance, viewer_count FROM r WHERE relevance >= 2 ORDER BY viewer_count DESC, relevance DESC, id LIMIT 8""")
def headline_streams(spark, sf):
    return vd.rank_streams_for_headline(_streams(spark, sf), _HEAD).select("id", "relevance", "viewer_count")


@case("top_city_cameras", f"""WITH {_STREAMS}, x AS (SELECT *, lower(title || ' ' || channel_name) AS t FROM streams WHERE {_ROOMSQL} IS NULL),
 y AS (SELECT *, 10 * len(list_intersect({_STOKS.format('t')}, ['therhean', 'thanea'])) + len(list_intersect({_STOKS.format('t')}, ['thanedble', 'attion', 'rewh', 'nicht'])) AS sc FROM x WHERE contains(t, 'city cam')
   AND NOT regexp_matches(t, '\\b(breaking|conflict|election|headlines|newscast|newsroom|politics|war)\\b'))
 SELECT id, sc::INTEGER AS location_score, viewer_count FROM y WHERE sc > 0 ORDER BY sc DESC, viewer_count DESC, title, id LIMIT 8""")
def cameras(spark, sf):
    return vd.rank_city_cameras(_streams(spark, sf), "thanedble attion rewh nicht", "therhean thanea", vd.newsroom_table(spark)).select("id", "location_score", "viewer_count")


# --- landed files derived from the tables -----------------------------------------------------
def _xml(x):
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def _rss(spark, sf, *extra, title=None, link=None):
    """Documents landed as RSS files."""
    a = c.articles(spark, sf)
    date = F.concat(F.lit("Mon, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    path = landing(spark, "rss")
    a.select(
        _xml(F.col("title") if title is None else title).alias("title"), (F.col("url") if link is None else link).alias("link"),
        F.col("id").alias("guid"), date.alias("pubDate"), _xml(F.col("description")).alias("description"), *extra,
    ).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return path


def _landed(title="title", publisher="publisher_name", where="") -> str:
    return f"""{ART}, n AS (SELECT {sql_strip(title)} AS title, {sql_strip('description')} AS description, url, id AS guid, {publisher} AS publisher_name,
   epoch_us(date_trunc('second', published_at)) AS published_at_us FROM art)
 SELECT {s.stable_id('guid')} AS id, title, nullif(trim(description), '') AS description, url, publisher_name, published_at_us FROM n WHERE title <> '' AND NOT {s.non_event('title')} {where}"""


def _landed_cols(df):
    return df.select("id", "title", F.nullif(F.trim("description"), F.lit("")).alias("description"), "url", "publisher_name", us("published_at"))


@case("src_rss_publisher", _landed(publisher="'Desk'"))
def rss_publisher(spark, sf):
    return _landed_cols(sf_.read_rss_articles(spark, _rss(spark, sf), "publisher", "Desk", "https://desk.example"))


@case("src_rss_search", _landed())
def rss_search(spark, sf):
    source = F.struct(F.col("publisher_name").alias("_VALUE"), F.concat(F.lit("https://"), "publisher_name", F.lit(".example")).alias("_url")).alias("source")
    path = _rss(spark, sf, source, title=F.concat("title", F.lit(" - "), "publisher_name"))
    return _landed_cols(sf_.read_rss_articles(spark, path, "search"))


def _channel(batches):
    """One RSS document per partition."""
    import pandas as pd

    line = lambda text: pd.DataFrame({"value": [text]})
    yield line('<rss xmlns:News="https://feeds.example/news"><channel>')
    yield from batches
    yield line("</channel></rss>")


@case("src_rss_redirect", _landed())
def rss_redirect(spark, sf):
    esc = lambda x: F.replace(F.replace(F.replace(_xml(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    link = F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?url="), F.url_encode("url"), F.lit("&c=1"))
    date = F.concat(F.lit("Mon, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = tag("item", F.concat(
        tag("title", esc(F.col("title"))), tag("link", esc(link)), tag("guid", F.col("id")), tag("pubDate", date),
        tag("description", esc(F.col("description"))), tag("News:Source", F.concat("publisher_name", F.lit(" on MSN"))),
    ))
    path = landing(spark, "rss")
    c.articles(spark, sf).select(item.alias("value")).mapInPandas(_channel, "value string").write.text(path)
    return _landed_cols(sf_.read_rss_articles(spark, path, "redirect"))


@case("src_article_json", f"""{ART}, n AS (SELECT {sql_strip('title')} AS title, url, 'src' || substr(publisher_name, 4) || '.example' AS publisher_name, epoch_us(date_trunc('second', published_at)) AS published_at_us FROM art WHERE language = 'en')
 SELECT {s.stable_id('url')} AS id, title, url, publisher_name, published_at_us FROM n WHERE title <> '' AND NOT {s.non_event('title')}""")
def article_json(spark, sf):
    a = c.articles(spark, sf)
    item = F.struct(
        "url", "title", F.concat(F.lit("www."), "publisher_name", F.lit(".example")).alias("domain"),
        F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.when(F.col("language") == "en", "English").otherwise(F.col("language")).alias("language"), F.lit(None).cast("string").alias("socialimage"),
    )
    path = landing(spark, "json")
    a.select(F.to_json(F.struct(F.array(item).alias("articles"))).alias("value")).write.text(path)
    return sf_.read_article_json_lines(spark, path).select("id", "title", "url", "publisher_name", us("published_at"))


@case("src_provider_articles", f"{ART} SELECT id AS external_id, publisher_name AS publisher, epoch_us(published_at) AS published_at_us FROM art WHERE published_at >= TIMESTAMP '2024-01-02 00:00:00'")
def providers(spark, sf):
    a = c.articles(spark, sf).select(
        F.col("id").alias("external_id"), F.col("title").alias("headline"), "url", F.col("publisher_name").alias("publisher"),
        "published_at", F.col("description").alias("body_excerpt"), "language",
    )
    paths_ = []
    for cond in ("language = 'en'", "language <> 'en'"):
        paths_.append(landing(spark, "provider"))
        a.filter(cond).drop("language").write.parquet(paths_[-1])
    return sf_.read_provider_articles(spark, paths_, "2024-01-02 00:00:00").select("external_id", "publisher", us("published_at"))


@case("src_country_directory", f"WITH {s.DIRECTORY} SELECT ord::INTEGER AS ord, map_id, country_name AS name, iso2 FROM directory")
def country_directory(spark, sf):
    d = c.directory(spark, sf)
    f = F.struct(F.col("ord").cast("int").alias("o"), F.struct(
        F.col("map_id").alias("id"), F.struct(F.concat(F.lit(" "), "country_name", F.lit(" ")).alias("name"), "iso2").alias("properties")
    ).alias("f"))
    path = landing(spark, "geo")
    features = F.transform(F.sort_array(F.collect_list(f)), lambda x: x["f"])
    blank = F.array(F.struct(F.lit("x").alias("id"), F.struct(F.lit(" ").alias("name"), F.lit(None).cast("string").alias("iso2")).alias("properties")))
    d.agg(F.concat(features, blank).alias("features")).select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    return st.read_country_directory(spark, path)


@case("src_relational_tables", f"{ART}, {s.STORIES}, {s.BRIDGE} SELECT 'events' AS name, count(*) AS n FROM stories UNION ALL SELECT 'event_countries', count(*) FROM bridge UNION ALL SELECT 'articles', count(*) FROM art UNION ALL SELECT 'countries', count(*) FROM nation UNION ALL SELECT 'sources', count(DISTINCT publisher_name) FROM art")
def relational(spark, sf):
    root = landing(spark, "rel")
    put = lambda df, n: df.write.parquet(f"{root}/{n}")
    put(c.stories(spark, sf).drop("scoring_components"), "events")
    put(c.story_bridge(spark, sf), "event_countries")
    put(c.articles(spark, sf).select("id", F.col("title").alias("headline"), F.col("url").alias("original_url"), F.col("publisher_name").alias("source_id"), "published_at"), "articles")
    put(c.directory(spark, sf).select("iso2", F.col("country_name").alias("name"), "map_id"), "countries")
    put(c.articles(spark, sf).select(F.col("publisher_name").alias("id"), "publisher_name").distinct(), "sources")
    t = st.read_relational_tables(spark, root)
    out = None
    for n, df in t.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@case("snk_snapshot", f"{ART} SELECT country_name, id FROM art")
def snapshot(spark, sf):
    root = landing(spark, "snap")
    a = c.articles(spark, sf).select("id", "country_name", "feed_name")
    st.write_snapshot(a.filter("feed_name = 'view'"), root)
    st.write_snapshot(a, root)
    return st.read_snapshot(spark, root, "id STRING, feed_name STRING, country_name STRING").select("country_name", "id")


@case("snk_world_feed", f"""{ART}, {s.WIDE},
 v AS (SELECT country_name, id, row_number() OVER (PARTITION BY country_name ORDER BY doc_id, id) AS k FROM art WHERE NOT {s.non_event('title')})
 SELECT ord, d.country_name, coalesce(string_agg(id, ',' ORDER BY k), '') AS ids, count(id) > 0 AS available FROM directory d LEFT JOIN v ON v.country_name = d.country_name GROUP BY ALL""")
def world_feed(spark, sf):
    rows = fd.world_feed(
        c.wide_directory(spark, sf), c.wide_directory(spark, sf).select("country_name", F.timestamp_seconds(F.lit(0)).alias("generated_at")),
        c.articles(spark, sf).withColumn("pos", F.col("doc_id")),
    )
    path = landing(spark, "world")
    st.publish_world_feed(rows, path)
    back = st.read_world_feed(spark, path, "ord LONG, country_name STRING, available BOOLEAN, articles ARRAY<STRUCT<id: STRING>>")
    return back.select("ord", "country_name", F.array_join(F.transform("articles", lambda x: x["id"]), ",").alias("ids"), "available")


@case("snk_world_pages", f"""{ART}, {s.WIDE}, v AS (SELECT country_name, id, row_number() OVER (PARTITION BY country_name ORDER BY doc_id, id) AS k, count(*) OVER (PARTITION BY country_name) AS total FROM art WHERE NOT {s.non_event('title')})
 SELECT ord, d.country_name, coalesce((k - 1) // 11, 0) AS page, coalesce(any_value(total), 0) AS total, coalesce(string_agg(id, ',' ORDER BY k), '') AS ids FROM directory d LEFT JOIN v ON v.country_name = d.country_name GROUP BY 1, 2, 3""")
def world_pages(spark, sf):
    d = c.wide_directory(spark, sf)
    rows = fd.world_feed_pages(d, d.select("country_name", F.timestamp_seconds(F.lit(0)).alias("generated_at")), c.articles(spark, sf).withColumn("pos", F.col("doc_id")), page_rows=11)
    path = landing(spark, "world-pages")
    st.publish_world_feed(rows, path)
    back = st.read_world_feed(spark, path, "ord LONG, country_name STRING, page LONG, total LONG, articles ARRAY<STRUCT<id: STRING>>")
    return back.select("ord", "country_name", "page", "total", F.array_join(F.transform("articles", lambda x: x["id"]), ",").alias("ids"))


# --- streaming ----------------------------------------------------------------------------
@case("stream_articles", f"""{ART}, n AS (SELECT {sql_strip('title')} AS title, id AS guid, date_trunc('second', published_at) AS published_at FROM art)
 SELECT {s.stable_id('guid')} AS id, epoch_us(published_at) AS published_at_us FROM n WHERE title <> '' AND NOT {s.non_event('title')} AND {s.english('title')} AND published_at >= TIMESTAMP '2024-01-10 06:00:00' - INTERVAL 8 DAY""")
def stream(spark, sf):
    from newsloom.streaming import ingest

    out = landing(spark, "stream-out")
    rows = ingest.stream_articles(spark, _rss(spark, sf), "2024-01-10 06:00:00", publisher_name="Desk", publisher_url="https://desk.example")
    query = rows.writeStream.format("parquet").option("checkpointLocation", landing(spark, "ckpt")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).select("id", us("published_at"))


@case("stream_dedupe", f"{ART} SELECT DISTINCT country_name, url AS article_key FROM art")
def stream_dedupe(spark, sf):
    from newsloom.streaming import ingest

    src, out = landing(spark, "src"), landing(spark, "out")
    a = c.articles(spark, sf).select("id", "url", "title", "country_name", "published_at")
    a.unionByName(a).write.parquet(src)
    rows = ingest.stream_dedupe(spark.readStream.schema(a.schema).parquet(src))
    query = rows.select("country_name", "article_key").writeStream.format("parquet").option("checkpointLocation", landing(spark, "ckpt")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("country_name string, article_key string").parquet(out)


@case("stream_last_known_good", f"""{ART}, cand AS (SELECT * FROM art WHERE NOT {s.non_event('title')})
 SELECT country_name, url, id FROM cand QUALIFY row_number() OVER (PARTITION BY country_name, url ORDER BY CASE WHEN language = 'en' THEN 1 ELSE 0 END, published_at DESC, id) = 1""")
def last_known(spark, sf):
    """Two landed batches, English first: the later arrival of a key wins."""
    from newsloom.streaming import ingest
    from newsloom.streaming.state import CountryState

    src, root = landing(spark, "src"), landing(spark, "state")
    a = c.articles(spark, sf).select("id", "url", "title", "description", "country_name", "published_at", "language")
    schema = "id STRING, url STRING, title STRING, description STRING, published_at TIMESTAMP, language STRING, country_name STRING"
    fold = ingest.last_known_good(root, schema, lambda batch, batch_id: c.AS_OF)
    ckpt = landing(spark, "ckpt")
    for cond in ("language = 'en'", "language <> 'en'"):
        a.filter(cond).write.mode("append").parquet(src)
        q = ingest.refresh(spark.readStream.schema(a.schema).parquet(src), fold, ckpt, once=True)
        q.awaitTermination()
    return CountryState(spark, root, schema).read(c.AS_OF).select("country_name", "url", "id")


@case("stream_readiness", f"""{ART}, {s.DIRECTORY} SELECT count(*) AS n, true AS published FROM directory""")
def readiness(spark, sf):
    from newsloom.streaming import ingest

    d, a = c.directory(spark, sf), c.articles(spark, sf)
    tried = d.select("country_name", F.current_timestamp().alias("last_attempt_at"))
    out = landing(spark, "ready")
    feed = fd.world_feed(d, tried.withColumnRenamed("last_attempt_at", "generated_at"), a.withColumn("pos", F.col("doc_id")))
    done = ingest.publish_when_ready(d, tried, a, a, lambda: st.publish_world_feed(feed, out))
    return st.read_world_feed(spark, out, "country_name string").agg(F.count("*").alias("n"), F.lit(done).alias("published"))


_DAY = "2024-01-02 06:00:00"


@case("stream_dropped", f"""{ART} SELECT country_name, id, CASE WHEN published_at < TIMESTAMP '{_DAY}' - INTERVAL 8 DAY THEN 'late' ELSE 'future' END AS reason FROM art
 WHERE published_at NOT BETWEEN TIMESTAMP '{_DAY}' - INTERVAL 8 DAY AND TIMESTAMP '{_DAY}' + INTERVAL 6 HOUR""")
def dropped(spark, sf):
    """STREAM-4: rows out of their time go to a side table, with the reason; every fifth day comes from the past."""
    from newsloom.streaming import ingest

    src, out = landing(spark, "src"), landing(spark, "dropped")
    a = c.articles(spark, sf).select("id", "country_name", "published_at")
    a.write.parquet(src)
    _, side = ingest.with_dropped(spark.readStream.schema(a.schema).parquet(src), _DAY)
    q = side.writeStream.format("parquet").option("checkpointLocation", landing(spark, "ckpt")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema("country_name string, id string, reason string").parquet(out)


@case("stream_cadence", f"""{ART}, cand AS (SELECT * FROM art WHERE NOT {s.non_event('title')})
 SELECT country_name, url, id, true AS several_triggers FROM cand QUALIFY row_number() OVER (PARTITION BY country_name, url ORDER BY CASE WHEN language = 'en' THEN 1 ELSE 0 END, published_at DESC, id) = 1""")
def cadence(spark, sf):
    """STREAM-5: a query that keeps running, one landed folder after the other, each in a trigger of its own."""
    from newsloom.streaming import ingest
    from newsloom.streaming.state import CountryState

    src, root = landing(spark, "src"), landing(spark, "state")
    a = c.articles(spark, sf).select("id", "url", "title", "description", "country_name", "published_at", "language")
    schema = "id STRING, url STRING, title STRING, description STRING, published_at TIMESTAMP, language STRING, country_name STRING"
    fold = ingest.last_known_good(root, schema, lambda batch, batch_id: c.AS_OF)
    a.limit(0).write.parquet(f"{src}/start")
    q = ingest.refresh(spark.readStream.schema(a.schema).parquet(f"{src}/*"), fold, landing(spark, "ckpt"), every="1 second")
    try:
        for name, cond in (("english", "language = 'en'"), ("others", "language <> 'en'")):
            land(spark, a.filter(cond), f"{src}/{name}")
            q.processAllAvailable()
        batches = q.lastProgress["batchId"] + 1
    finally:
        q.stop()
    return CountryState(spark, root, schema).read(c.AS_OF).select("country_name", "url", "id", F.lit(batches >= 2).alias("several_triggers"))


@case("stream_withheld", f"""{ART}, {s.WIDE}, {_ATT}, steps AS (SELECT unnest([1, 2]) AS step)
 SELECT step, (step = 2 OR (SELECT count(*) FROM directory WHERE country_name NOT IN (SELECT country_name FROM att)) = 0) AND (SELECT count(*) FROM art) > 0 AS published,
   CASE WHEN step = 2 THEN (SELECT count(*) FROM directory) ELSE 0 END AS n FROM steps""")
def withheld(spark, sf):
    """STREAM-6: nothing is published while a country is unattempted; the next round, with all attempted, is."""
    from newsloom.streaming import ingest

    d, a, out = c.wide_directory(spark, sf), c.articles(spark, sf), landing(spark, "withheld")
    some = _attempts(spark, sf)
    every = d.select("country_name", F.current_timestamp().alias("last_attempt_at"))
    feed = fd.world_feed(d, every.withColumnRenamed("last_attempt_at", "generated_at"), a.withColumn("pos", F.col("doc_id")))
    steps = []
    for step, attempts in ((1, some), (2, every)):
        done = ingest.publish_when_ready(d, attempts, a, a, lambda: st.publish_world_feed(feed, out))
        n = st.read_world_feed(spark, out, "country_name string").count() if done else 0
        steps.append((step, done, n))
    return spark.createDataFrame(steps, "step int, published boolean, n long")


# --- the world view -------------------------------------------------------------------------
@case("view_world")
def world(spark, sf):
    from newsloom.plans import world as w

    a = c.articles(spark, sf)
    d = c.directory(spark, sf)
    _, feeds = w.world_view(
        a.filter("feed_name = 'view'"), a.filter("feed_name <> 'view'"), d, c.gazetteer(spark), c.AS_OF, c.LEX, longest=c.LONGEST
    )
    full = w.complete_world(d, cut(feeds), c.AS_OF)
    return full.select("country_name", F.explode_outer("events").alias("e")).select("country_name", "e.headline", "e.category", "e.importance_score")
