"""Fixed schemas of landed files and stored tables."""

from __future__ import annotations

_MEDIA = "ARRAY<STRUCT<_url: STRING, _type: STRING, _width: STRING, _height: STRING>>"

RSS_ITEM = f"""
  title STRING, link STRING, guid STRING, pubDate STRING, published STRING, updated STRING,
  `dc:date` STRING, description STRING, `content:encoded` STRING,
  source STRUCT<_VALUE: STRING, _url: STRING>, `News:Source` STRING, `News:Image` STRING,
  `News:ImageUrl` STRING, image STRING, `media:content` {_MEDIA},
  `media:thumbnail` {_MEDIA}, enclosure {_MEDIA}
"""
ARTICLE_LIST = """
  articles ARRAY<STRUCT<url: STRING, title: STRING, domain: STRING, seendate: STRING,
  language: STRING, socialimage: STRING>>
"""
PROVIDER_ARTICLES = "external_id STRING, headline STRING, url STRING, publisher STRING, published_at TIMESTAMP, body_excerpt STRING"
GEOJSON = """
  features ARRAY<STRUCT<id: STRING, properties: STRUCT<name: STRING, iso2: STRING>,
  geometry: STRUCT<type: STRING, coordinates: STRING>>>
"""
CAPITALS = "iso2 STRING, iso3 STRING, capital STRING, lat DOUBLE, lng DOUBLE"
_TEXT = "STRUCT<simpleText: STRING, runs: ARRAY<STRUCT<text: STRING>>>"
STREAM_RECORD = f"""
  videoId STRING, title {_TEXT}, ownerText {_TEXT}, longBylineText {_TEXT},
  detailedMetadataSnippets ARRAY<STRUCT<snippetText: {_TEXT}>>, descriptionSnippet {_TEXT},
  viewCountText {_TEXT}, badges ARRAY<STRUCT<metadataBadgeRenderer: STRUCT<style: STRING>>>,
  thumbnail STRUCT<thumbnails: ARRAY<STRUCT<url: STRING, width: INT, height: INT>>>
"""
COUNTRIES = "iso2 STRING, iso3 STRING, name STRING, map_id STRING, region STRING"
SOURCES = "id STRING, publisher_name STRING, url STRING, country_code STRING, prominence_score DOUBLE"
EVENTS = """
  event_id STRING, headline STRING, summary STRING, category STRING, importance_score INT,
  importance_label STRING, geographic_scope STRING, primary_country STRING,
  first_seen_at TIMESTAMP, last_updated_at TIMESTAMP, scoring_components MAP<STRING, DOUBLE>,
  scoring_input MAP<STRING, DOUBLE>, generated_summary BOOLEAN, active BOOLEAN
"""
EVENT_COUNTRIES = "event_id STRING, country_code STRING"
EVENT_ARTICLES = """
  id STRING, headline STRING, original_url STRING, source_id STRING, published_at TIMESTAMP,
  extracted_countries ARRAY<STRING>, category STRING, event_id STRING
"""
TABLES = {
    "countries": COUNTRIES, "sources": SOURCES, "events": EVENTS,
    "event_countries": EVENT_COUNTRIES, "articles": EVENT_ARTICLES,
}
