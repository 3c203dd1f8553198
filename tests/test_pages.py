"""Paged documents, the lexicon as a table, and renderers at any depth."""

import json

from pyspark.sql import functions as F

from newsloom import dims
from newsloom.operators import classify as cl, feeds as fd
from newsloom.sources import tables as st


def test_a_hot_country_is_many_rows(spark):
    """A third of all events in one country: no row and no slice holds more than its bound."""
    events = spark.range(3000).select(
        F.format_string("e%05d", "id").alias("event_id"), F.lit("h").alias("headline"), F.lit("c").alias("category"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.format_string("c%d", F.col("id") % 40)).alias("country_name"),
        (F.col("id") % 7 * 1.5).alias("importance_score"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("last_updated_at"),
    )
    names = events.select("country_name").distinct().unionByName(spark.createDataFrame([("NONE",)], "country_name string"))
    pages = fd.complete_country_pages(names, events, "2024-01-01 00:00:00", page_rows=30).collect()
    whole = {r.country_name: [x.event_id for x in r.events] for r in fd.complete_country_feeds(names, events, "2024-01-01 00:00:00").collect()}
    assert max(len(r["items"]) for r in pages) == 30 and [r.total for r in pages if r.country_name == "NONE"] == [0]
    got = {}
    for r in sorted(pages, key=lambda r: (r.country_name, r.page)):
        got.setdefault(r.country_name, []).extend(x.event_id for x in r["items"])
        assert r.n_pages == max(1, -(-r.total // 30))
    assert got == whole and len(got["HOT"]) == 1000


def test_lexicon_of_200000_terms(spark):
    """A table far beyond what a plan can hold gives what its few matching terms give inlined."""
    some = {"Politics": ["election", "prime minister", "u.s. senate"], "Sports": ["world cup", "goals", "cup"], "Health": ["vaccine"], "Economy": ["central bank"], "Conflict and security": ["troops"]}
    terms = spark.createDataFrame([(k, t) for k, ts in some.items() for t in ts], "category string, term string")
    more = spark.range(200_000).select(F.element_at(F.array(*[F.lit(k) for k in some]), (F.col("id") % len(some) + 1).cast("int")).alias("category"), F.format_string("term%d of%d", "id", "id").alias("term"))
    titles = ["Prime Minister wins election", "World Cup goal, cup won", "Vaccine vaccine central bank", "U.S. Senate votes", "Troops strike the border", "News bulletin: election", "term5 of5 stands here", "Nothing", None, "", "prime, minister"]
    articles = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    lexicon = dims.lexicon_from({k: [*v, "term5 of5"] if k == "Sports" else v for k, v in some.items()})
    more = more.filter("category <> 'Sports'").unionByName(spark.createDataFrame([("Sports", "term5 of5"), ("Sports", None), (None, "x"), ("Sports", "  ")], "category string, term string"))
    more = more.filter("term is null or term <> 'term5 of5' or category = 'Sports'")
    want = {r.id: r.category for r in cl.classify_headlines(articles, lexicon).collect()}
    got = {r.id: r.category for r in cl.classify_by_table(articles, cl.prepare_lexicon(terms.unionByName(more))).collect()}
    assert got == want and len(set(got.values())) >= 5


def _record(i, **more):
    return {"videoRenderer": {"videoId": f"video{i:03d}", "title": {"simpleText": f"T{i}"}, "ownerText": {"runs": [{"text": "C"}]}, "badges": [{"metadataBadgeRenderer": {"style": st.LIVE_BADGE}}], **more}}


def test_renderers_at_any_depth(spark):
    deep = _record(9)
    for _ in range(12):
        deep = {"x": [[1, "videoRenderer", {"y": deep, "n": None}]]}
    nested = _record(4)
    nested["videoRenderer"]["inner"] = [_record(5)]
    bodies = [
        _record(1), {"contents": [_record(2), {"other": 1}, _record(3)]}, nested, deep, [_record(6), [_record(7)]],
        {"videoRenderer": "text"}, {"nothing": []}, "videoRenderer", {"a": [_record(8, viewCountText={"simpleText": "2K"}), _record(8, viewCountText={"simpleText": "1K"})]},
    ]
    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(90, None), (91, "not json {"), (92, "")]
    got = {r.id: r for r in st.search_live_streams(spark.createDataFrame(rows, "ord long, body string")).collect()}
    assert sorted(got) == [f"video{i:03d}" for i in range(1, 10)]
    assert got["video008"].viewer_count == 1000  # the later of two comes first
    assert st.search_live_streams(spark.createDataFrame([], "ord long, body string")).count() == 0
