"""SRC-1..4: landed feed files to article rows. All readers also work on ``readStream``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import text as tx
from newsloom.operators.quality import normalize_articles
from newsloom.session import computed

FLAVOURS = ("publisher", "search", "redirect")


def _reader(spark: SparkSession, stream: bool | int):
    """A batch reader, or a stream reader; a number bounds the files of a micro-batch."""
    if not stream:
        return spark.read
    return spark.readStream if stream is True else spark.readStream.option("maxFilesPerTrigger", stream)


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _first(*cols: str) -> Column:
    return F.coalesce(*[_blank(c) for c in cols])


def _media(c: str, image_only: bool = False) -> Column:
    small = lambda v: F.coalesce(v.try_cast("int").between(1, 2), F.lit(False))

    def usable(m: Column) -> Column:
        ok = ~small(m["_width"]) & ~small(m["_height"]) & F.coalesce(tx.safe_url(m["_url"]).isNotNull(), F.lit(False))
        return ok & (m["_type"].isNull() | m["_type"].startswith("image/")) if image_only else ok

    return F.transform(F.filter(F.coalesce(F.col(c), F.array()), usable), lambda m: m["_url"])


def pick_image() -> Column:
    """First usable media or enclosure image, then image elements, then an inline image."""
    media = F.concat(_media("`media:content`"), _media("`media:thumbnail`"), _media("enclosure", True))
    body = tx.decode_entities(F.concat_ws(" ", "description", "`content:encoded`"))
    inline = F.regexp_extract(body, r"""(?i)<img(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])src=["']([^"']+)["']""", 1)
    tags = [tx.safe_url(F.col(c)) for c in ("`News:Image`", "`News:ImageUrl`", "image")]
    return F.coalesce(F.try_element_at(media, F.lit(1)), *tags, F.nullif(inline, F.lit("")))


def original_url(link: Column) -> Column:
    """The target of a redirect link that carries it in its ``url`` parameter."""
    host = tx.url_host(link)
    target = F.try_url_decode(F.regexp_extract(link, r"[?&]url=([^&#]+)", 1))
    redirect = (host == "bing.com") | host.endswith(".bing.com")
    return F.when(redirect, F.coalesce(tx.safe_url(target), tx.safe_url(link))).otherwise(tx.safe_url(link))


def raw_rss(spark: SparkSession, path: str, stream: bool | int = False) -> DataFrame:
    """One row per ``<item>`` with a fixed schema and the file it came from."""
    return (
        _reader(spark, stream).format("xml").schema(schemas.RSS_ITEM).option("rowTag", "item")
        .option("ignoreNamespace", "false").load(path).withColumn("landed_file", F.col("_metadata.file_path"))
    )


def rss_to_raw(items: DataFrame, flavour: str, publisher_name: str = "", publisher_url: str = "") -> DataFrame:
    """Items of one flavour to the input of ``normalize_articles``.

    ``publisher``: one outlet's own feed. ``search``: the outlet is in ``<source url>``
    and repeated at the end of the title. ``redirect``: the outlet is in ``News:Source``
    and the link hides the original URL.
    """
    if flavour not in FLAVOURS:
        raise ValueError(f"flavour must be one of {FLAVOURS}")
    date = _first("pubDate", "published", "updated", "`dc:date`") if flavour == "publisher" else _blank("pubDate")
    text = _first("description", "`content:encoded`") if flavour == "publisher" else F.col("description")
    title, url, guid = F.col("title"), F.trim("link"), _blank("guid")
    name, site = F.lit(publisher_name), F.lit(publisher_url)
    if flavour == "search":
        name, site = F.trim(F.coalesce("source._VALUE", F.lit(""))), F.col("source._url")
        suffix = F.concat(F.lit(" - "), name)
        title = F.when(
            title.endswith(suffix), F.trim(title.substr(F.lit(1), F.length(title) - F.length(suffix)))
        ).otherwise(title)
    elif flavour == "redirect":
        items = computed(items, "*", original_url(F.trim("link")).alias("_target"))
        url = F.col("_target")
        name = F.trim(F.regexp_replace(F.coalesce("`News:Source`", F.lit("")), r"(?i)\s+on\s+MSN$", ""))
        site, guid = tx.url_origin(url), F.coalesce(_blank("guid"), url)
    return items.select(
        title.alias("title"), url.alias("url"), name.alias("publisher_name"), site.alias("publisher_url"),
        date.alias("published"), text.alias("description"), guid.alias("guid"), pick_image().alias("image_url"),
        *[c for c in ("landed_file", "feed_name") if c in items.columns],
    )


def read_rss_articles(spark: SparkSession, path: str, flavour: str = "publisher", publisher_name: str = "", publisher_url: str = "", stream: bool | int = False) -> DataFrame:
    """SRC-1/2."""
    return normalize_articles(rss_to_raw(raw_rss(spark, path, stream), flavour, publisher_name, publisher_url))


def read_article_json(spark: SparkSession, path: str, stream: bool | int = False) -> DataFrame:
    """SRC-3: ``{articles: [...]}`` files; entries in another language are dropped."""
    return article_list(_reader(spark, stream).schema(schemas.ARTICLE_LIST).option("multiLine", True).json(path))


def read_article_json_lines(spark: SparkSession, path: str, stream: bool | int = False) -> DataFrame:
    """SRC-3 over JSON lines, one article list per line: splittable, for large landings."""
    return article_list(_reader(spark, stream).schema(schemas.ARTICLE_LIST).json(path))


def article_list(docs: DataFrame) -> DataFrame:
    a = docs.select(F.explode("articles").alias("a")).select("a.*")
    a = a.filter(F.coalesce(F.lower("language"), F.lit("")).isin("", "english"))
    domain = _blank("domain")
    raw = a.select(
        "title", "url",
        F.coalesce(F.regexp_replace(domain, r"^www\.", ""), F.lit("Independent publisher")).alias("publisher_name"),
        F.concat(F.lit("https://"), domain).alias("publisher_url"),
        F.col("seendate").alias("published"), F.lit("").alias("description"),
        F.col("url").alias("guid"), F.col("socialimage").alias("image_url"),
    )
    return normalize_articles(raw)


def read_provider_articles(spark: SparkSession, paths: list[str], since=None, fmt: str = "parquet") -> DataFrame:
    """SRC-4: attributed metadata of several providers since a time; no event ids or scores."""
    parts = [spark.read.format(fmt).schema(schemas.PROVIDER_ARTICLES).load(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("published_at") >= F.lit(since).cast("timestamp")) if since is not None else out


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """SET-1."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
