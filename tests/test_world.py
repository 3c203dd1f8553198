from pyspark.sql import functions as F

from newsloom import dims
from newsloom.operators import countries as co
from newsloom.plans import world

LEX = dims.lexicon_from(dims.STARTER_LEXICON)


def test_world_view_is_complete_and_attaches_global_events(spark):
    cols = "id string, title string, description string, publisher_name string, published_at string, country_name string"
    def load(rows):
        df = spark.createDataFrame(rows, cols)
        return df.withColumns({"published_at": F.to_timestamp("published_at"), "url": F.concat(F.lit("https://e.example/"), F.col("id"))})

    glob = load([
        ("g1", "Earthquake shakes Alpha capital overnight", "", "Reuters", "2024-01-02 10:00:00", None),
        ("g2", "Old summit in Beta closes", "", "CNN", "2023-12-20 10:00:00", None),
    ])
    local = load([
        ("l1", "Beta parliament passes railway budget", "", "BBC News", "2024-01-02 09:00:00", "Beta"),
        ("l2", "Earthquake shakes Alpha capital", "", "BBC News", "2024-01-02 09:30:00", "Alpha"),
    ])
    directory = spark.createDataFrame([(0, "Alpha", "m0", "AA"), (1, "Beta", "m1", None), (2, "Gamma", "m2", "GG")], "ord long, country_name string, map_id string, iso2 string")
    gaz = co.prepare_gazetteer(spark.createDataFrame([("Alpha", "Alpha"), ("Beta", "Beta"), ("Gamma", "Gamma")], "country string, term string"))
    g, feeds = world.world_view(glob, local, directory, gaz, "2024-01-02 12:00:00", LEX, longest=1)
    assert [(r.primary_country, list(r.affected_countries)) for r in g.collect()] == [("AA", ["AA"])]  # the old one is gone
    rows = {r.country_name: r for r in world.complete_world(directory, feeds, "2024-01-02 12:00:00").collect()}
    assert {k: len(r.events) for k, r in rows.items()} == {"Alpha": 1, "Beta": 1, "Gamma": 0}
    merged = [r for r in feeds.collect() if r.country_name == "Alpha"][0]
    assert merged.independent_source_count == 2 and len(merged.articles) == 2
    assert list(merged.affected_countries) == ["AA"] and merged.geographic_scope == "National"
