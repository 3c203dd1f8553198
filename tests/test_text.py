from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import scoring, text as tx
from newsloom.operators import classify as cl, quality as ql

LEX = dims.lexicon_from(dims.STARTER_LEXICON)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, "U.S. troops visit the United Kingdom", tx.tokens) == ["usa", "troop", "visit", "uk"]
    assert one(spark, "Cities, cities and studies: hot Canadian winning", tx.tokens) == ["city", "study", "heat", "canada", "winn"]
    assert one(spark, "Police shooting suspect near harbour bridge", tx.identity_tokens) == ["near", "harbour", "bridge"]
    assert one(spark, "AI and the EU vs FC", tx.tokens) == ["ai", "eu", "vs", "fc"]


def test_stems_agree(spark):
    words = ["games", "series", "policies", "floods", "crisis", "crashes", "bombing", "pass", "status", "wanted", "buses", "warnings"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(tx.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [tx.stem_py(w) for w in words]


def test_ids_keys_urls(spark):
    assert one(spark, "ab", tx.stable_id) == "lekqmi"
    assert one(spark, "BBC & Co.", tx.publisher_key) == "bbc and co"
    assert one(spark, "Ｒｅｕｔｅｒｓ.com", tx.publisher_key) == "reuters"
    assert one(spark, "HTTPS://WWW.Example.ORG/A?x=1", tx.safe_url) == "https://www.example.org/A?x=1"
    assert one(spark, "ftp://example.org/a", tx.safe_url) is None
    assert one(spark, "https://news.pacific-desk.co.uk/x", tx.publisher_from_url) == "Pacific Desk"
    assert one(spark, "https://pacific-desk.example/x", tx.publisher_from_url) == "Pacific Desk"


def test_dates(spark):
    as_text = lambda c: F.date_format(tx.parse_date(c), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "Fri, 02 Feb 2024 10:00:00 GMT", as_text) == "2024-02-02 10:00:00"
    assert one(spark, "2 Feb 2024 10:00:00 +0200", as_text) == "2024-02-02 08:00:00"
    assert one(spark, "20240202T100000Z", as_text) == "2024-02-02 10:00:00"
    assert one(spark, "2024-02-02T10:00:00+01:00", as_text) == "2024-02-02 09:00:00"
    assert one(spark, "not-a-date", as_text) is None


def test_markup(spark):
    assert one(spark, "<b>A &amp; B</b>&#8217;s &#x41; ☀ day", tx.strip_markup) == "A & B ’s A day"
    assert one(spark, "x" * 10, lambda c: tx.truncate_words(c)) == "x" * 10
    long = "word " * 60
    assert one(spark, long.strip(), lambda c: tx.truncate_words(c)) == ("word " * 35).strip() + "…"


def test_headline_rules(spark):
    bad = ["", "Politics", "World & Business", "Error: page", "Latest Fiji news", "Sports news and updates"]
    good = ["Minister resigns after budget vote", "Storm closes ports & airports across the northern coast today"]
    assert all(one(spark, t, tx.is_non_event_title) for t in bad)
    assert not any(one(spark, t, tx.is_non_event_title) for t in good)
    assert not one(spark, "Президент подписал закон", tx.is_english)
    assert not one(spark, "Les ministres sont dans la rue pour une marche", tx.is_english)
    assert one(spark, "The mayor of El Paso speaks", tx.is_english)


def test_classification(spark):
    cases = {
        "Ceasefire talks stall as army moves": "Conflict and security",
        "Strike near the border city leaves questions": "Conflict and security",
        "New tariffs announced": "Economy",
        "World cup match ends in late goal": "Sports",
        "Latest news bulletin for Friday": "Other",
        "Weekly horoscope": "Other",
        "Mayor opens a bridge": "Local affairs",
        "Civil, war-like words": "Conflict and security",
    }
    df = cl.classify_headlines(spark.createDataFrame([(k,) for k in cases], "title string"), LEX)
    assert {r.title: r.category for r in df.collect()} == cases


def test_scoring_vectors(spark):
    rows = [
        (None, None, None, None, 0.0, 0.0, 0.0, 0.0, 0, "Early"),
        (1, 1, 0.0, 0.0, 14.2, 0.0, 20.0, 0.0, 34, "Early"),
        (2, 1, 1.0, 2.0, 22.5, 16.7, 19.9, 0.0, 59, "Strong"),
        (3, 2, 84.0, 0.5, 28.4, 4.2, 10.0, 2.0, 45, "Building"),
        (5, 1, 24.0, 1.0, 36.7, 8.3, 17.1, 0.0, 62, "Strong"),
        (40, 60, 0.0, 20.0, 45.0, 25.0, 20.0, 10.0, 100, "Very strong"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "s int, c int, a double, r double")
    got = df.select(scoring.score_struct(F.col("s"), F.col("c"), F.col("a"), F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(g) for g in got] == [r[4:] for r in rows]
    nan = spark.createDataFrame([(float("nan"),)], "a double").select(scoring.score_struct(F.lit(1), F.lit(1), F.col("a"), F.lit(0)).alias("x")).first()
    assert nan.x.freshness == 0.0


def test_colors_and_windows(spark):
    assert one(spark, "Sports", lambda c: scoring.fill_color(c, F.lit(100))) == "#84cc16"
    assert one(spark, None, lambda c: scoring.fill_color(c, F.lit(10))) == dims.COLOR_NO_CATEGORY
    got = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.5, 12.4, 30.0, 72.0)], "h double").select(scoring.window_label(F.col("h")).alias("w")).collect()
    assert [r.w for r in got] == ["a single report", "30 minutes", "1.5 hours", "12 hours", "1.3 days", "3 days"]


def test_normalize_drops_and_derives(spark):
    cols = "title string, url string, publisher_name string, published string, description string, guid string"
    rows = [
        ("Storm hits coast towns", "https://pacific-desk.example/a", "", "Fri, 02 Feb 2024 10:00:00 GMT", "Seen by Pacific Desk today", "g1"),
        ("Storm hits coast towns", "https://x.example/a", "X", "not-a-date", "", "g2"),
        ("Access denied", "https://x.example/b", "X", "2024-02-02T10:00:00Z", "", "g3"),
        ("Storm hits coast towns", "mailto:x", "X", "2024-02-02T10:00:00Z", "", "g4"),
    ]
    out = ql.normalize_articles(spark.createDataFrame(rows, cols)).collect()
    assert [(r.publisher_name, r.publisher_url) for r in out] == [("Pacific Desk", "https://pacific-desk.example")]
    assert "Pacific" not in out[0].searchable_text


def test_current_window(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-09 07:00:00"), ("c", "2024-01-05 00:00:00")], "title string, t string").withColumn("published_at", F.to_timestamp("t"))
    assert [r.title for r in ql.filter_current(df, "2024-01-09 00:30:00").collect()] == ["c"]
