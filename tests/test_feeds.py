from pyspark.sql import functions as F

from newsloom import dims
from newsloom.operators import countries as co, events as ev, feeds as fd, geo, merge as mg, publishers as pub
from newsloom.sources import tables as st

LEX = dims.lexicon_from(dims.STARTER_LEXICON)


def at(df, *cols):
    return df.withColumns({c: F.to_timestamp(c) for c in cols})


def articles(spark, rows):
    df = spark.createDataFrame(rows, "id string, title string, description string, publisher_name string, published_at string, country_name string")
    return at(df.withColumn("url", F.concat(F.lit("https://e.example/"), F.col("id"))), "published_at")


STORY = [
    ("a1", "Wildfire near harbor town forces evacuation", "Crews fight a wildfire close to the harbor town. More soon", "Reuters", "2024-01-02 10:00:00", "Aland"),
    ("a2", "Harbor town wildfire: evacuation widens", "", "BBC News", "2024-01-02 10:30:00", "Aland"),
    ("b1", "Parliament passes railway budget", "", "CNN", "2024-01-02 09:00:00", "Borduria"),
]


def test_build_events_pair(spark):
    e = {r.cluster_id: r for r in ev.build_events(articles(spark, STORY), "2024-01-02 12:00:00", LEX).collect()}
    fire = e["a2"]
    assert (fire.article_count, fire.coverage_window_hours, fire.articles_per_hour) == (2, 0.5, 2.0)
    assert fire.independent_source_count == 2 and len(fire.articles) == 2
    assert fire.category == "Weather and disasters" and fire.importance_label == "Strong"
    assert fire.summary == "Crews fight a wildfire close to the harbor town."
    assert set(e) == {"a2", "b1"}


def test_scoped_events_do_not_mix(spark):
    rows = [(i + c, t, d, p, when, c) for c in ("X", "Y") for i, t, d, p, when, _ in STORY[:2]]
    e = ev.build_events(articles(spark, rows), "2024-01-02 12:00:00", LEX, scope="country_name").collect()
    assert sorted((r.primary_country, r.article_count, r.geographic_scope) for r in e) == [("X", 2, "National"), ("Y", 2, "National")]


def test_balanced_and_unbalanced_sources(spark):
    names = [("Reuters", 96), ("BBC News", 91), ("CNN", 85), ("NBC News", 87), ("Fox News", 80), ("Local Desk", 58), ("Euronews", 80)]
    rows = [(f"a{i}", n, p) for i, (n, p) in enumerate(names)]
    df = ev.with_publisher(spark.createDataFrame(rows, "id string, publisher_name string, p int").withColumns({
        "g": F.lit(1), "published_at": F.timestamp_seconds(F.lit(1_700_000_000)),
    }))
    pick = lambda b: [r.publisher_name for r in pub.balanced_top_sources(df, ["g"], 5, F.lit(b)).orderBy("rank").collect()]
    assert pick(False) == ["Reuters", "BBC News", "NBC News", "CNN", "Euronews"]
    assert pick(True) == ["Reuters", "BBC News", "NBC News", "Euronews", "Fox News"]


def test_perspective_mix(spark):
    rows = [("Associated Press",), ("AP News",), ("Reuters",), ("My Blog",)]
    df = ev.with_publisher(spark.createDataFrame(rows, "publisher_name string")).withColumn("g", F.lit(1))
    r = pub.publisher_perspective_mix(df, ["g"]).first()
    assert (r.left_pct, r.center_pct, r.right_pct, r.unrated_pct, r.total) == (34, 33, 0, 33, 3)


def test_gazetteer_rules(spark):
    terms = spark.createDataFrame([("United States", "US"), ("Georgia", "Georgia"), ("Jordan", "Jordan"), ("Niger", "Niger")], "country string, term string")
    over = spark.createDataFrame([("Georgia", "Tbilisi"), ("Georgia", "Georgia's parliament")], "country string, term string")
    g = co.prepare_gazetteer(terms, over)
    texts = [(1, "US widens talks"), (2, "join us today"), (3, "Georgia team wins"), (4, "Georgia's parliament votes"), (5, "Jordan shoes sold"), (6, "King of Jordan arrives"), (7, "Niger-Delta spill"), (8, "Nigeria votes")]
    df = spark.createDataFrame(texts, "id int, text string")
    m = co.match_countries(df, g)
    rules = spark.createDataFrame([("Jordan", "(?i)king", None, None)], "country string, must_match string, reject_if string, unless string")
    got = sorted((r.id, r.country) for r in co.reject_homonyms(m, df, rules).collect())
    assert got == [(1, "United States"), (4, "Georgia"), (6, "Jordan"), (7, "Niger")]


def test_empty_scan_keeps_stories(spark):
    cur = articles(spark, STORY[:1])
    out = fd.merge_country_feed(cur.limit(0), cur, "2024-01-03 00:00:00")
    assert [r.id for r in out.collect()] == ["a1"]
    old = fd.merge_country_feed(cur.limit(0), cur, "2024-01-20 00:00:00")
    assert old.count() == 0


def test_progress_and_latest_source(spark):
    d = spark.createDataFrame([(0, "A"), (1, "B")], "ord int, country_name string")
    tried = spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("B", "2024-01-01 00:00:00")], "country_name string, last_attempt_at string")
    news = spark.createDataFrame([("A",)], "country_name string")
    assert fd.collection_progress(d, tried, news, news).first().ready
    assert not fd.collection_progress(d, tried.limit(1), news, news).first().ready
    left = at(spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("B", None)], "country_name string, updated_at string"), "updated_at")
    right = at(spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("B", "2024-01-01 00:00:00")], "country_name string, updated_at string"), "updated_at")
    got = {r.country_name: (r.fresh_side, r.previous_side) for r in mg.latest_feed_source(left, right).collect()}
    assert got == {"A": ("left", "right"), "B": ("right", "left")}


def test_snapshot_pointer(spark, tmp_path):
    root, schema = str(tmp_path / "snap"), "id STRING, country_name STRING"
    assert st.read_snapshot(spark, root, schema).count() == 0
    for ids in (["x"], ["y", "z"]):
        st.write_snapshot(spark.createDataFrame([(i, "A") for i in ids], schema), root)
    assert sorted(r.id for r in st.read_snapshot(spark, root, schema).collect()) == ["y", "z"]


def test_points_and_centers(spark):
    box = lambda x0, x1, y0, y1: [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1)), (float(x0), float(y0))]
    rows = [
        (0, "s", "Square", "p0", 0, box(0, 10, 0, 10)), (0, "s", "Square", "p0", 1, box(4, 6, 4, 6)),
        (1, "d", "Dateline", "p1", 0, [(179.0, -2.0), (-179.0, -2.0), (-179.0, 2.0), (179.0, 2.0), (179.0, -2.0)]),
    ]
    polys = spark.createDataFrame(rows, "ord int, country_id string, name string, polygon_id string, ring_id int, ring array<struct<lon:double,lat:double>>")
    pts = [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 179.5, 0.0), (5, -179.5, 0.0), (6, 4.0, 5.0), (7, float("nan"), 0.0), (8, 2.0, 91.0), (9, 50.0, 0.0), (10, 362.0, 2.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {r.id: r.name for r in geo.points_in_polygons(df, geo.prepare_polygons(polys)).collect()}
    assert got == {1: "Square", 2: None, 3: "Square", 4: "Dateline", 5: "Dateline", 6: "Square", 7: None, 8: None, 9: None, 10: "Square"}
    c = {r.name: (round(r.lon, 6), round(r.lat, 6)) for r in geo.polygon_centers(polys).collect()}
    assert c == {"Square": (5.0, 5.0), "Dateline": (-180.0, 0.0)}


def test_viewer_counts(spark):
    df = spark.createDataFrame([("483 watching",), ("1.2K watching",), ("3M",), ("1,234",), ("none",)], "t string")
    assert [r.v for r in df.select(st.viewer_count(F.col("t")).alias("v")).collect()] == [483, 1200, 3_000_000, 1234, 0]


def test_gate_keeps_large_feeds_without_a_limit(spark):
    from pyspark.sql import functions as F

    from newsloom.operators.quality import gate_feeds

    feeds = spark.createDataFrame([("big", 9_000_000), ("small", 10), ("none", 5)], "feed_name string, body_chars long")
    articles = spark.createDataFrame([("big", "Flood hits town"), ("small", "Vote held today")], "feed_name string, title string").withColumn(
        "published_at", F.lit("2024-01-04 00:00:00").cast("timestamp")
    )
    status = lambda limit: {r.feed_name: r.status for r in gate_feeds(feeds, articles, "2024-01-05 00:00:00", limit)[1].collect()}
    assert status(None) == {"big": "ok", "small": "ok", "none": "failed"}
    assert status(1_500_000) == {"big": "failed", "small": "ok", "none": "failed"}


def test_rows_that_share_an_id_count_each(spark):
    rows = [
        ("g1", "Flood destroys bridge in northern valley", "Alpha Post"), ("g1", "Flood destroys bridge in northern valley", "Beta Times"),
        ("g1", "Parliament passes budget after long debate", "Alpha Post"), ("g2", "Parliament passes budget after long debate", "Gamma News"),
    ]
    a = spark.createDataFrame([(i, t, p, f"https://x.example/{k}") for k, (i, t, p) in enumerate(rows)], "id string, title string, publisher_name string, url string")
    from pyspark.sql import functions as F

    a = a.withColumn("published_at", F.lit("2024-01-02 10:00:00").cast("timestamp")).withColumn("searchable_text", F.col("title"))
    e = ev.build_events(a, "2024-01-02 12:00:00", LEX).collect()
    assert sorted((r.headline[:5], r.article_count, r.independent_source_count) for r in e) == [("Flood", 2, 2), ("Parli", 2, 2)]
    assert {x.id for r in e for x in r.articles} == {"g1", "g2"}
