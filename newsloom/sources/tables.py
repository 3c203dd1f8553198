"""SRC-5..8 and SNK-1/2."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import text as tx
from newsloom.operators.grouping import first_row
from newsloom.operators.video import channel_key
from newsloom.session import computed, cut
from newsloom.sources.commits import CommitLog

SNAPSHOT_VERSION = 1
# Fixed patterns.
STREAM_ID = r"^[A-Za-z0-9_-]{6,20}$"
LIVE_BADGE = "BADGE_STYLE_TYPE_LIVE_NOW"


def _features(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.GEOJSON).option("multiLine", True).json(path)
    f = F.posexplode("features").alias("ord", "f")
    return docs.select(f).select(
        "ord", F.col("f.id").alias("map_id"), F.trim("f.properties.name").alias("name"), F.col("f.properties.iso2").alias("iso2"),
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_country_directory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: ord, map_id, name, iso2; distinct non-empty names in file order."""
    rows = _features(spark, path).filter("map_id <> '' and name <> ''").select("ord", "map_id", "name", "iso2")
    return first_row(rows, ["name"], [F.col("ord")]).select("ord", "map_id", "name", "iso2")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Country rings as rows: ord, country_id, name, polygon_id, ring_id, ring."""
    rings = "array<array<array<double>>>"
    f = _features(spark, path)
    one = f.filter("kind = 'Polygon'").withColumn("polys", F.array(F.from_json("coordinates", rings)))
    many = f.filter("kind = 'MultiPolygon'").withColumn("polys", F.from_json("coordinates", f"array<{rings}>"))
    both = one.unionByName(many).select("ord", F.col("map_id").alias("country_id"), "name", F.posexplode("polys").alias("p", "poly"))
    return both.select(
        "ord", "country_id", "name", F.format_string("%05d-%05d", "ord", "p").alias("polygon_id"),
        F.posexplode("poly").alias("ring_id", "pts"),
    ).select(
        "ord", "country_id", "name", "polygon_id", "ring_id",
        F.transform("pts", lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat"))).alias("ring"),
    )


def clean_capitals(df: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(finite("lat") & finite("lng") & (F.coalesce("capital", F.lit("")) != "N/A") & ~((F.col("lat") == 0) & (F.col("lng") == 0)))


def read_capitals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6."""
    return clean_capitals(spark.read.schema(schemas.CAPITALS).option("multiLine", True).json(path))


def text_value(c: str) -> Column:
    runs = F.array_join(F.transform(F.col(f"{c}.runs"), lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return F.trim(F.coalesce(F.col(f"{c}.simpleText"), runs, F.lit("")))


def viewer_count(c: Column) -> Column:
    plain = F.replace(c, F.lit(","), F.lit(""))
    pattern = r"(?i)([\d.]+)\s*([KMB])?"
    unit = F.upper(F.regexp_extract(plain, pattern, 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    number = F.regexp_extract(plain, pattern, 1).try_cast("double")
    return F.coalesce(F.floor(number * factor + 0.5).cast("long"), F.lit(0).cast("long"))


def parse_live_streams(records: DataFrame) -> DataFrame:
    """SRC-7: renderer records to one row per live stream.

    Several records of one id keep the smallest ``ord`` (input position).
    """
    title = tx.clean_display(text_value("title"))
    owner, byline = text_value("ownerText"), text_value("longBylineText")
    channel = tx.clean_display(F.when(owner != "", owner).otherwise(byline))
    snippet = F.col("detailedMetadataSnippets")[0]["snippetText"]
    runs = F.array_join(F.transform(snippet["runs"], lambda r: F.coalesce(r["text"], F.lit(""))), "")
    detailed = F.trim(F.coalesce(snippet["simpleText"], runs, F.lit("")))
    about = tx.clean_display(F.when(detailed != "", detailed).otherwise(text_value("descriptionSnippet")))
    about = F.trim(F.regexp_replace(F.regexp_replace(about, r"(?i)https?://\S+", ""), r"\s+", " "))
    about = tx.truncate_words(about, 320, 220, "...")
    live = F.exists(F.coalesce("badges", F.array()), lambda b: F.coalesce(b["metadataBadgeRenderer"]["style"] == LIVE_BADGE, F.lit(False)))
    area = lambda t: F.coalesce(t["width"], F.lit(0)) * F.coalesce(t["height"], F.lit(0))
    sized = F.sort_array(
        F.transform(F.coalesce("thumbnail.thumbnails", F.array()), lambda t, i: F.struct(area(t).alias("a"), (-i).alias("i"), t["url"].alias("u"))), asc=False
    )
    thumb = F.try_element_at(sized, F.lit(1))["u"]
    out = computed(
        records.filter(live & F.col("videoId").rlike(STREAM_ID)), "ord", F.col("videoId").alias("id"), title.alias("title"), channel.alias("channel_name"), about.alias("_about"),
        viewer_count(text_value("viewCountText")).alias("viewer_count"),
        F.when(thumb.startswith("http"), thumb).alias("thumbnail_url"),
    ).filter("title <> '' and channel_name <> ''")
    same = channel_key(F.col("_about")) == channel_key(F.col("title"))
    out = out.withColumn("coverage_description", F.when((F.col("_about") != "") & ~same, F.col("_about"))).drop("_about")
    return first_row(out, ["id"], [F.col("ord")]).drop("ord")


def read_live_stream_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7 over landed JSON lines, one renderer record per line."""
    rows = spark.read.schema(schemas.STREAM_RECORD).json(path).withColumn(
        "ord", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    )
    return parse_live_streams(rows)


def find_renderers(bodies: DataFrame, ord_: str = "ord", body: str = "body") -> DataFrame:
    """SRC-7: every renderer record of JSON documents, at whatever depth: (ord, record columns).

    Documents are taken apart level by level as VARIANT, objects and arrays alike; only parts that still name a record
    are opened further, and the search ends with the level that has none. Within a document later parts come first, as
    in a search by stack, and a record before those inside it (members of an object in order of their names); ``ord`` is
    (position of the document, path). A body that is no JSON, or null, has no records.
    """
    name = "videoRenderer"
    level = bodies.select(F.col(ord_).alias("doc"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(body)).alias("v")).filter("v is not null")
    found = None
    while True:
        level = cut(level.filter(F.to_json("v").contains(f'"{name}"')))
        if level.isEmpty():
            break
        inside = level.select("doc", "path", "v").lateralJoin(bodies.sparkSession.tvf.variant_explode(F.col("v").outer()))
        inside = inside.select("doc", F.col("path").alias("above"), F.concat("path", F.array(-F.col("pos"))).alias("path"), "key", F.col("value").alias("v"))
        # the record counts where its parent stands
        records = inside.filter(F.col("key") == name).select("doc", F.col("above").alias("path"), F.from_json(F.to_json("v"), schemas.STREAM_RECORD).alias("r")).filter("r.videoId is not null")
        found = records if found is None else found.unionByName(records)
        level = inside.select("doc", "path", "v")
    if found is None:
        found = bodies.sparkSession.createDataFrame([], f"doc long, path array<int>, r struct<{schemas.STREAM_RECORD}>")
    return found.select(F.struct("doc", "path").alias("ord"), "r.*")


def search_live_streams(bodies: DataFrame, ord_: str = "ord", body: str = "body") -> DataFrame:
    """SRC-7 over whole documents: the live streams of all records in them."""
    return parse_live_streams(find_renderers(bodies, ord_, body))


def read_relational_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SRC-8: the five tables from parquet folders with fixed schemas."""
    return {name: spark.read.schema(s).parquet(f"{root}/{name}") for name, s in schemas.TABLES.items()}


def read_relational_jdbc(spark: SparkSession, url: str, partition: dict | None = None, **options: str) -> dict[str, DataFrame]:
    """SRC-8 over JDBC; ``partition`` maps a table to its partitioning options."""
    out = {}
    for name in schemas.TABLES:
        extra = (partition or {}).get(name, {})
        out[name] = spark.read.format("jdbc").options(url=url, dbtable=name, **options, **extra).load()
    return out


# --- sinks ----------------------------------------------------------------------------
KEEP_SNAPSHOTS = 3


def write_snapshot(df: DataFrame, root: str, partition_by: str | None = "country_name", keep: int = KEEP_SNAPSHOTS) -> str:
    """SNK-1: a new run folder, then the next version of the log makes it current; older runs go after ``keep`` versions."""
    log, run = CommitLog(root), uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        # one country goes to few files; a hot one is split
        writer = df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by)
    writer.parquet(log.run_path(run))
    log.append(lambda _: {"runs": [run], "format": SNAPSHOT_VERSION})
    log.expire(keep)
    return run


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest committed run of this format, or an empty table."""
    log = CommitLog(root)
    for version in reversed(log.versions()):
        entry = log.entry(version)
        if entry.get("format") == SNAPSHOT_VERSION:
            return spark.read.schema(schema).parquet(log.run_path(entry["runs"][0]))
    return spark.createDataFrame([], schema)


def publish_world_feed(rows: DataFrame, root: str, keep: int = KEEP_SNAPSHOTS) -> int:
    """SNK-2: the ordered world feed as JSON lines of a new run; its version makes it the current one at once."""
    log, run = CommitLog(root), uuid.uuid4().hex
    rows.write.json(log.run_path(run))
    version = log.append(lambda _: {"runs": [run]})
    log.expire(keep)
    return version


def read_world_feed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The published world feed; an error before the first one."""
    version, entry = CommitLog(root).latest()
    if not version:
        raise FileNotFoundError(f"no world feed in {root}")
    return spark.read.schema(schema).json(CommitLog(root).run_path(entry["runs"][0]))
