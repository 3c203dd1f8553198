"""Forms that stay small on large data, against the plain rule."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom import dims, schemas
from newsloom.functions import text as tx
from newsloom.operators import cluster as cu, countries as co, geo, merge as mg, quality as ql, similarity as sm
from newsloom.sources import tables as st


def test_event_coverage_equals_the_rule(spark):
    rng = random.Random(8)
    pool = [a + b for a in ("storm", "river", "bridge", "mart", "sum") for b in ("alfa", "beta", "gam", "de")]
    say = lambda n: " ".join(rng.choice(pool[: rng.choice([4, 20])]) for _ in range(n))
    events = spark.createDataFrame(
        [(i, say(rng.randint(0, 12)), [(say(5),), (say(9),)]) for i in range(40)] + [(99, None, [])],
        "event_key int, headline string, articles array<struct<headline:string>>",
    )
    articles = spark.createDataFrame(
        [(f"a{i % 190}", say(rng.randint(0, 10)), say(6)) for i in range(200)] + [("none", None, None)], "id string, title string, description string"
    )
    heads = events.select("event_key", F.explode(F.concat(F.array("headline"), F.transform("articles", lambda a: a["headline"]))).alias("h"))
    heads = [(r.event_key, set(r.t or [])) for r in heads.select("event_key", tx.identity_tokens(F.col("h")).alias("t")).collect()]
    bodies = [(r.id, set(r.t)) for r in articles.select("id", tx.identity_tokens(F.concat_ws(" ", "title", "description")).alias("t")).collect()]

    def reports(head, body):
        s, d, n = len(head & body), sum(len(x) >= 6 for x in head & body), len(head)
        if n <= 4:
            return s >= 3 or (s >= 2 and d >= 1 and s / n >= 0.66)
        return s >= 4 or (s >= 3 and s / n >= 0.4) or (s >= 2 and d >= 1 and s / n >= 0.5)

    want = {(k, i) for k, h in heads for i, b in bodies if reports(h, b)}
    got = [tuple(r) for r in mg.match_event_coverage(events, articles).collect()]
    assert 0 < len(want) < 40 * 190 and set(got) == want and len(got) == len(want)


def test_a_large_gazetteer_gives_the_same_countries(spark, monkeypatch):
    terms = spark.createDataFrame([("France", "France"), ("Chad", "Chad"), ("United States", "US"), ("Guinea-Bissau", "Guinea-Bissau")], "country string, term string")
    texts = spark.createDataFrame([(1, "France and Chad meet in France"), (2, "give us a hand"), (3, "the US, Guinea-Bissau"), (4, None), (5, "")], "id int, text string")
    gazetteer = co.prepare_gazetteer(terms)
    run = lambda: sorted(tuple(r) for r in co.match_countries(texts, gazetteer).collect())
    plain = run()
    assert plain == [(1, "Chad"), (1, "France"), (3, "Guinea-Bissau"), (3, "United States")]
    monkeypatch.setattr(co, "is_small", lambda *a: False)
    assert run() == plain


def test_events_of_two_countries_never_pair(spark):
    heads = ["Earthquake destroys historic bridge near Lakewood village", "Earthquake destroys historic bridge near Lakewood harbour"]
    rows = [(2 * c + k, f"c{c}", "Disaster", h, []) for c in range(30) for k, h in enumerate(heads)]
    events = spark.createDataFrame(rows, "event_key long, country_name string, category string, headline string, articles array<struct<headline:string>>")
    events = events.withColumn("last_updated_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    got = sorted(tuple(r) for r in mg.same_occurrence_pairs(events, scope=["country_name"]).collect())
    assert got == [(2 * c, 2 * c + 1) for c in range(30)]


def test_a_ring_of_many_points_across_the_antimeridian(spark):
    turn = "i * 2 * pi() / 100000"
    ring = f"transform(sequence(0, 99999 + cast(id as int)), i -> named_struct('lon', pmod(360 + 10 * cos({turn}), 360D) - 180, 'lat', 10 * sin({turn})))"
    polygons = spark.range(1).selectExpr("1 as ord", "'1' as country_id", "'Round' as name", "'1' as polygon_id", "0 as ring_id", f"{ring} as ring")
    points = spark.createDataFrame([(1, 179.0, 0.0), (2, -179.0, 5.0), (3, 0.0, 0.0), (4, 165.0, 0.0), (5, 171.0, 9.0)], "id int, lon double, lat double")
    got = {r.id: r.name for r in geo.points_in_polygons(points, geo.prepare_polygons(polygons)).collect()}
    assert got == {1: "Round", 2: "Round", 3: None, 4: None, 5: None}
    center = geo.polygon_centers(polygons).first()
    assert abs(abs(center.lon) - 180) < 1e-6 and abs(center.lat) < 1e-6


def test_unwrapped_rings_are_continuous(spark):
    rows = [([(170.0, 0.0), (-170.0, 1.0), (170.0, 2.0), (-175.0, 3.0), (179.0, 4.0)],), ([(1.0, 2.0)],), ([],)]
    got = [[p.lon for p in r.u] for r in spark.createDataFrame(rows, "ring array<struct<lon:double,lat:double>>").select(geo.unwrap(F.col("ring")).alias("u")).collect()]
    assert got == [[170.0, 190.0, 170.0, 185.0, 179.0], [1.0], []]


def _reports(spark, rows):
    df = spark.createDataFrame(rows, "id string, title string, description string, h int").withColumn("published_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    analysed = sm.analyse(df, dims.lexicon_from({"Sports": ["cup", "goal"], "Health": ["virus", "clinic"]}))
    reports = sm.reports_of(analysed)
    return reports, sm.nodes_of(analysed, reports)


def test_pairs_in_tiles_equal_those_of_token_blocks(spark):
    rng = random.Random(4)
    pool = ["harbor", "bridge", "council", "virus", "clinic", "cup", "goal", "railway", "volcano", "senate", "tunnel", "festival"]
    say = lambda low, high: " ".join(rng.choices(pool, k=rng.randint(low, high)))
    rows = [(f"a{i:03d}", say(1, 7), say(0, 9), rng.randint(0, 300)) for i in range(80)]
    rows += [(f"b{i:03d}", *rows[i % 20][1:3], rng.randint(0, 300)) for i in range(40)]  # copies in several windows
    reports, nodes = _reports(spark, rows)
    pairs, dense = sm.candidate_pairs(reports, nodes)
    assert dense is None
    want = {(r.a, r.b, bool(r.same_category), r.similarity) for r in sm.score_pairs(pairs, reports).collect()}
    for tile_rows in (4, 4096):
        got = [tuple(r) for r in sm.similar_reports(reports, nodes, tile_rows=tile_rows).collect()]
        assert len(got) == len(want) > 100 and set(got) == want


def test_a_dense_group_has_few_edges(spark):
    """300 texts that all link: the edges between them don't grow with their square, and all get one label."""
    rows = [(f"a{i:03d}", f"harbor bridge council vote item{i}", "", i % 60) for i in range(300)]
    reports, nodes = _reports(spark, rows)
    edges = sm.link_edges(reports, nodes, tile_rows=100)
    assert edges.count() < 10 * 300
    assert cu.propagate(edges).select("label").distinct().count() == 1


def test_pictographs_are_told_by_one_comparison_first(spark):
    points = spark.range(1, 0x20000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert points.filter(F.col("c").rlike(tx.PICTOGRAPHS) != F.col("c").rlike(tx._PICTOGRAPHS)).isEmpty()
    display = tx._PICTOGRAPHS[:-1] + r"\x{FE0F}\x{200D}]"
    assert points.filter(F.col("c").rlike(tx.DISPLAY_MARKS) != F.col("c").rlike(display)).isEmpty()


def test_filters_do_not_repeat_what_is_computed(spark):
    """Titles and texts are cleaned once per row, not again in every condition of a filter below the projection."""
    raw = spark.createDataFrame([("Storm hits the coast", "https://e.example/a", "E", "2024-01-02", "x")], "title string, url string, publisher_name string, published string, description string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ql.normalize_articles(raw.repartition(2))).count("<[^>]+>") == 3  # title, description, publisher's name
    record = spark.createDataFrame([], schemas.STREAM_RECORD + ", ord long").repartition(2)
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        filters = [x for x in plan(st.parse_live_streams(record)).splitlines() if "Filter" in x]
        assert filters and not any("FE0F" in x for x in filters)
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def test_links_inside_blocks_are_judged_once(spark):
    """Two blocks with many links are thinned by the links inside either, which are found once per block and not again per pair of blocks."""
    rows = [(f"a{i:03d}", f"harbor bridge council vote item{i}", "", i % 60) for i in range(120)]
    reports, nodes = _reports(spark, rows)
    held = nodes.select("report", F.lit(0).alias("w"), F.lit("").alias("scope"), "node", "us", F.lit(False).alias("several_nodes"))
    facts = reports.select("report", "category", F.size("ids").alias("n_ids"), F.size("context").alias("n_context"), *sm.LISTS)
    table = held.join(facts, "report").withColumn("slice", (F.col("report") % 2).cast("int")).toArrow()
    blocks = [table.filter(pa.array([x == k for x in table["slice"].to_pylist()])) for k in (0, 1)]
    blobs = [sm._packer()((pa.scalar(0), pa.scalar(0), pa.scalar(k)), b)["rows"][0].as_py() for k, b in enumerate(blocks)]
    batch = pa.RecordBatch.from_pylist([{"bucket": 0, "w": 0, "slice": k, "rows": b} for k, b in enumerate(blobs)])
    Side, similar = sm._tools()
    left, right = (Side(r["rows"]) for x in sm._inside(72)([batch]) for r in x.to_pylist())
    calls = []
    judge = lambda a, b, same, linked: (calls.append(same), similar(a, b, same, linked))[1]
    own = list(sm._edges(72)(left, left, True, judge))[0]
    both = list(sm._edges(72)(left, right, False, judge))[0]
    assert calls == [False]
    assert 0 < own.num_rows < 10 * 60 and 0 < both.num_rows < 10 * 120


def test_folds_of_a_dense_feed_have_few_edges(spark):
    """Events that all describe one occurrence get one label from few edges; of two scopes, and of repeated positions, none is lost."""
    rows = [(i % 290, f"c{i % 2}", "Disaster", f"harbor bridge council vote item{i}", [], i) for i in range(300)]
    events = spark.createDataFrame(rows, "event_key long, country_name string, category string, headline string, articles array<struct<headline:string>>, h int")
    events = events.withColumn("last_updated_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    pairs = mg.same_occurrence_pairs(events, scope=["country_name"])
    edges = mg.same_occurrence_edges(events, ["country_name"])
    assert edges.count() < 10 * 300 < pairs.count() and edges.join(pairs, ["a", "b"], "left_anti").isEmpty()
    labels = lambda e: sorted(tuple(r) for r in cu.propagate(e.select(F.col("a").alias("src"), F.col("b").alias("dst"))).collect())
    assert labels(edges) == labels(pairs) and {label for _, label in labels(edges)} == {0, 1}


def test_covering_articles_are_not_copied_to_every_event(spark, tmp_path):
    """40 long articles cover 30 events each: what is kept on disk doesn't hold their texts 30 times."""
    title = "Earthquake destroys historic bridge near Lakewood village"
    long_text = " ".join(f"word{i}" for i in range(2000)) + "."
    articles = spark.createDataFrame([(f"a{i}", title, long_text if i else "A short text that is a whole sentence of its own.", f"P{i % 3}", i) for i in range(40)], "id string, title string, description string, publisher_name string, h int")
    articles = articles.withColumn("published_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 60)).drop("h")
    nested = ", ".join(f"{c}:{t}" for c, t in [("id", "string"), ("headline", "string"), ("url", "string"), ("image_url", "string"), ("publisher_name", "string"), ("publisher_url", "string"), ("publisher_key", "string"), ("prominence", "int"), ("published_at", "timestamp"), ("category", "string")])
    events = spark.createDataFrame(
        [(i, title, "old", "Disaster", [], 1, 1, 5.0, 1, 0.0, 0.0) for i in range(30)],
        f"event_key long, headline string, summary string, category string, articles array<struct<{nested}>>, independent_source_count long, affected_country_count int, age_hours double, article_count long, coverage_window_hours double, articles_per_hour double",
    )
    folder = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        got = mg.enrich_events_with_coverage(events, articles.repartition(2), "2023-11-15 00:00:00", dims.lexicon_from({"Sports": ["cup"]})).collect()
    finally:
        if folder:
            spark.sparkContext.setCheckpointDir(folder.removeprefix("file:"))
    assert {(r.summary, r.independent_source_count) for r in got} == {("A short text that is a whole sentence of its own.", 3)} and len(got) == 30
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 10 * 40 * len(long_text)
