"""Distributed forms against plain sequential folds on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import text as tx
from newsloom.operators import cluster as cu, dedupe as dd, similarity as sm

LEX = dims.lexicon_from({"Sports": ["cup", "goal"], "Health": ["virus", "clinic"]})


def scan(rows):
    urls, titles, kept = set(), set(), []
    for r, a, b in sorted(rows):
        if a not in urls and b not in titles:
            urls.add(a), titles.add(b), kept.append(r)
    return kept


def test_keep_first_example_and_random(spark):
    rng = random.Random(5)
    cases = [[(0, "u1", "t1"), (1, "u1", "t2"), (2, "u2", "t2")]]
    cases += [[(i, f"u{rng.randint(0, 12)}", f"t{rng.randint(0, 12) if rng.random() < .7 else 0}") for i in range(60)] for _ in range(2)]
    for rows in cases:
        df = spark.createDataFrame(rows, "r int, a string, b string")
        got = sorted(x.r for x in dd.keep_first(df, [F.col("r")], F.col("a"), F.col("b")).collect())
        assert got == scan(rows)


def test_propagate_example(spark):
    edges = spark.createDataFrame([(0, 2), (1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    got = {r.node: r.label for r in cu.propagate(edges).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def _similar(x, y):
    (tx_, cx, _, _), (ty, cy, _, _) = x, y
    common = [t for t in tx_ if t in set(ty)]
    if not tx_ or not ty:
        return 0.0
    cont = len(common) / min(len(tx_), len(ty))
    phrase = set(zip(tx_, tx_[1:])) & set(zip(ty, ty[1:]))
    if phrase and len(common) >= 3:
        return 1.0
    if len(common) >= 3 and cont >= 0.38:
        return cont
    if sum(len(t) >= 7 for t in common) >= 2 and cont >= 0.3:
        return cont
    shared = len(set(cx) & set(cy))
    if cx and cy and len(common) >= 2 and shared >= 5 and shared / min(len(cx), len(cy)) >= 0.24:
        return max(cont, shared / min(len(cx), len(cy)))
    return 0.0


def _linked(x, y):
    s = _similar(x, y)
    return abs(x[3] - y[3]) <= 72 * 3600 and s > 0 and (x[2] == y[2] or s >= 0.6)


def sequential(rows):
    """Greedy first-fit over analysed rows in scan order; returns {id: seed id}."""
    clusters = []
    for ident, data in rows:
        for members in clusters:
            if any(_linked(m, data) for _, m in members):
                members.append((ident, data))
                break
        else:
            clusters.append([(ident, data)])
    return {i: members[0][0] for members in clusters for i, _ in members}, clusters


WORDS = ["harbor", "bridge", "council", "virus", "clinic", "cup", "goal", "railway", "volcano", "senate", "tunnel", "festival", "glacier", "orchard"]


def make(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.35:  # copies, some at the same time
            _, title, desc, hour = rng.choice(rows)
            if rng.random() < 0.5:
                hour = rng.randint(0, 200)
        else:
            title = " ".join(rng.choices(WORDS, k=rng.randint(2, 7)))
            desc = " ".join(rng.choices(WORDS, k=rng.randint(0, 8)))
            hour = rng.randint(0, 200)
        rows.append((f"a{i:03d}", title, desc, hour))
    return rows


@pytest.mark.parametrize("seed,block,dense", [(1, 256, 2048), (2, 3, 4), (3, 2, 2)])
def test_clusters_match_sequential_scan(spark, seed, block, dense):
    rows = make(random.Random(seed), 70)
    df = spark.createDataFrame(rows, "id string, title string, description string, h int").withColumn(
        "published_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600)
    )
    analysed = sm.analyse(df, LEX).select("id", "title_tokens", "category", F.unix_seconds("published_at").alias("t"), "content", "copy").collect()
    words = {r.id: r.c for r in df.select("id", tx.identity_tokens(F.concat_ws(" ", "title", "description")).alias("c")).collect()}
    first = {}
    for r in analysed:
        key = (r.content, r.copy, r.t)
        first[key] = min(first.get(key, r.id), r.id)
    order = sorted(analysed, key=lambda r: (-r.t, first[(r.content, r.copy, r.t)], r.id))
    want, clusters = sequential([(r.id, (r.title_tokens, words[r.id], r.category, r.t)) for r in order])
    assigned, reports, similar = cu.cluster_articles(df, LEX, block_rows=block, dense_rows=dense)
    assert {r.id: r.cluster_id for r in assigned.collect()} == want
    # representatives: most similar mates, then prominence, then recency
    prom = {r.id: 50 + int(r.id[1:]) % 3 for r in analysed}
    best = {}
    for members in clusters:
        links = {i: sum(1 for j, y in members if j != i and _similar(x, y) > 0) for i, x in members}
        best[members[0][0]] = min(members, key=lambda m: (-links[m[0]], -prom[m[0]], -m[1][3], m[0]))[0]
    ranked = assigned.withColumn("prominence", F.lit(50) + F.substring("id", 2, 3).cast("int") % 3)
    for known in (None, similar):
        got = {r.cluster_id: r.id for r in cu.representative_articles(ranked, reports, known, batch=2, salt_rows=3).collect()}
        assert got == best


def test_hot_copies_stay_linear(spark):
    """A third of all rows are one text: no pairs of copies are made."""
    df = spark.range(3000).select(
        F.format_string("a%05d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "harbor bridge council vote").otherwise(F.format_string("item%d topic%d place%d", "id", "id", "id")).alias("title"),
        F.lit("").alias("description"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("published_at"),
    )
    analysed = sm.analyse(df, LEX)
    reports = sm.reports_of(analysed)
    nodes = sm.nodes_of(analysed, reports)
    pairs, dense = sm.candidate_pairs(reports, nodes)
    assert dense is None and pairs.count() == 0
    chain = sm.chain_edges(nodes.join(nodes.groupBy("report").count().filter("count > 1"), "report", "left_semi"), ["report"])
    assert chain.count() == 999
    assert cu.cluster_articles(df, LEX)[0].groupBy("cluster_id").count().agg(F.max("count")).first()[0] == 1000


def test_interleave_example(spark):
    rows = [("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("x", 1, 0), ("y", 1, 1)]
    df = spark.createDataFrame(rows, "id string, feed_ord int, feed_pos int").withColumns({
        "title": F.concat(F.lit("The title of "), F.col("id")), "url": F.concat(F.lit("https://e.example/"), F.col("id")),
    })
    assert [r.id for r in dd.interleave_feeds(df, 4, slice_rows=2).collect()] == ["a", "x", "b", "y"]
