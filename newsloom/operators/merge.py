"""JOIN-8..10, AGG-4/5, DEDUP-2..5, FLT-9/10: merging events and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import text as tx
from newsloom.operators import cluster as cu, events as ev, publishers as pub, similarity as sm
from newsloom.operators.countries import event_text, match_countries, regeo
from newsloom.operators.grouping import consecutive, first_row, highest, newest
from newsloom.session import cut, small_side, ts

SAME_HOURS = 96
RETENTION = "INTERVAL 7 DAYS"
ROLLOVER_GUARD = "INTERVAL 5 MINUTES"


def _with_first(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(a, b): the smallest ``pos`` of each key with every other one."""
    first = rows.groupBy(*keys).agg(F.min(pos).alias("a"))
    return rows.select(*keys, F.col(pos).alias("b")).join(first, keys).filter("a < b").select("a", "b")


# --- JOIN-8 -----------------------------------------------------------------------------
def _headlines(events: DataFrame, key: str, scope: list[str], *more: Column) -> DataFrame:
    """The headline of each event and those of its articles, each token list once an event (``sm.event_pairs``)."""
    heads = F.array_distinct(F.concat(F.array("headline"), F.transform("articles", lambda a: a["headline"])))
    # events without one of the scope's values, or without a time, meet none
    known = F.lit(True)
    for c in [*scope, "last_updated_at"]:
        known = known & F.col(c).isNotNull()
    event = F.col(key).cast("long").alias("report")
    held = events.filter(known & F.col(key).isNotNull()).select(
        event, F.unix_micros("last_updated_at").alias("us"), (F.to_json(F.struct(*scope)) if scope else F.lit("")).alias("scope"), F.explode(heads).alias("h")
    )
    held = held.withColumn("t", tx.identity_tokens(F.col("h"))).drop("h").filter(F.size("t") >= 2).distinct()
    about = events.select(event, "category", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"), *more).distinct()
    several = (F.count("*").over(Window.partitionBy("report")) > 1).alias("several")
    return cut(
        held.join(about, "report").select(
            "*", several, F.transform("t", lambda x: F.xxhash64(x)).alias("ids"),
            F.transform(F.filter("t", lambda x: F.length(x) >= 7), lambda x: F.xxhash64(x)).alias("long_ids"),
            F.transform(sm._phrases(F.col("t")), lambda x: F.xxhash64(x)).alias("phrase_ids"),
        ).drop("t")
    )


def _worded(events: DataFrame, key: str, scope: list[str], *more: str) -> DataFrame:
    cols = [key, *scope, "category", "last_updated_at", "headline", "articles", *more]
    return cut(events.select(*dict.fromkeys(cols), tx.sorted_tokens(F.col("headline")).alias("tokens")))


def same_occurrence_pairs(
    events: DataFrame, key: str = "event_key", scope: list[str] | None = None,
    block_rows: int = sm.BLOCK_ROWS, dense_rows: int = sm.TILE_ROWS, star: bool = False,
) -> DataFrame:
    """JOIN-8: (a, b) with a < b, pairs of events that describe one occurrence.

    ``key`` is the numeric position of an event.

    Equal token sets match at any distance (given as a chain of neighbours, or as the first one with each other one
    if ``star``); otherwise some headline pair has to be
    similar within 96 hours, in one category or with four common headline tokens.
    ``scope`` columns restrict pairs to equal values (for instance one country).
    """
    scope = scope or []
    base = _worded(events, key, scope)
    near = sm.event_pairs(_headlines(base, key, scope), SAME_HOURS, dense_rows)
    kind = events.schema[key].dataType
    return near.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).unionByName(_equal(base, key, scope, star)).distinct()


def _equal(base: DataFrame, key: str, scope: list[str], star: bool) -> DataFrame:
    # Equal token sets: chain the members of a group instead of pairing all of them.
    worded = base.filter(F.size("tokens") > 0)
    return _with_first(worded, [*scope, "tokens"], key) if star else consecutive(worded, [*scope, "tokens"], key)


def same_occurrence_edges(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(a, b) with a < b: as many pairs of ``same_occurrence_pairs`` as give every event the same label."""
    scope = scope or []
    base = _worded(events, "event_key", scope)
    return sm.event_edges(_headlines(base, "event_key", scope), SAME_HOURS)[0].unionByName(_equal(base, "event_key", scope, False)).distinct()


# --- AGG-5 ------------------------------------------------------------------------------
def merge_events(events: DataFrame, group: str, top: int = 5) -> DataFrame:
    """AGG-5: one event per ``group``; the row with the smallest ``feed_ord`` is canonical.

    Per publisher the most prominent, newest article stays; counters take the maximum,
    age the minimum; countries are united without GLOBAL. Aggregates combine map-side.
    """
    canon = first_row(
        events.select(group, "feed_ord", "id", "headline", "category", "geographic_scope", "primary_country"),
        [group], [F.col("feed_ord")],
    ).drop("feed_ord")
    articles = events.select(group, F.explode("articles").alias("x")).select(group, "x.*")
    ratings = F.create_map(*[F.lit(v) for k, b, _ in dims.PUBLISHER_RATINGS for v in (k, b)])
    one = first_row(articles, [group, "publisher_key"], [highest("prominence"), newest("published_at"), F.col("id")]).withColumn(
        "bucket", F.try_element_at(ratings, F.col("publisher_key"))
    )
    spread = one.groupBy(group).agg(F.count("*").alias("_n"), F.min("published_at").alias("_lo"), F.max("published_at").alias("_hi"))
    window, rate = ev.reporting(F.col("_lo"), F.col("_hi"), F.col("_n"))
    visible = pub.balanced_top_sources(
        one.join(canon.select(group, F.col("category").alias("_cat")), group), [group], top, pub.shows_perspective(F.col("_cat"))
    )
    lists = visible.groupBy(group).agg(ev.sorted_articles([F.col("rank")]).alias("articles"))
    countries = (
        events.select(group, "feed_ord", F.posexplode("affected_countries").alias("p", "c"))
        .filter("c <> '' and c <> 'GLOBAL'")
        .groupBy(group, "c").agg(F.min(F.struct("feed_ord", "p")).alias("o"))
        .groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "c"))), lambda s: s["c"]).alias("affected_countries"))
    )
    text = tx.clean_feed_text(F.col("summary"))
    bare = lambda c: F.lower(F.regexp_replace(c, r"[.!?]+$", ""))
    summaries = (
        events.select(group, "feed_ord", text.alias("s"))
        .filter((F.col("s") != "") & ~F.col("s").rlike(ev.BOILERPLATE))
        .join(canon.select(group, bare(tx.clean_feed_text(F.col("headline"))).alias("h")), group)
        .groupBy(group)
        .agg(F.min_by("s", F.struct((bare(F.col("s")) == F.col("h")).cast("int").alias("r"), F.length("s").alias("l"), "feed_ord")).alias("_s"))
    )
    sums = events.groupBy(group).agg(
        F.max("independent_source_count").alias("_src"), F.min("age_hours").alias("age_hours"),
        F.max("article_count").alias("_art"), F.max("coverage_window_hours").alias("_win"),
        F.max("articles_per_hour").alias("_rate"), F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_updated_at").alias("last_updated_at"),
    )
    out = (
        canon.join(sums, group).join(spread, group, "left").join(lists, group, "left")
        .join(countries, group, "left").join(summaries, group, "left")
        .withColumns({
            "independent_source_count": F.greatest("_src", "_n"),
            "article_count": F.greatest("_art", "_n"),
            "coverage_window_hours": F.greatest("_win", window),
            "articles_per_hour": F.greatest("_rate", rate),
            "summary": tx.truncate_words(F.coalesce("_s", ev.headline_sentence(F.col("headline")))),
            "articles": F.coalesce("articles", F.array().cast(events.schema["articles"].dataType)),
        })
    )
    affected = F.coalesce("affected_countries", F.array().cast("array<string>"))
    return regeo(out, affected).drop("_src", "_art", "_win", "_rate", "_n", "_lo", "_hi", "_s")


def _first_fit_groups(events: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Labels of the fold: every event joins the smallest ``feed_ord`` that reaches it."""
    order = events.select(F.col(key).alias("k"), "feed_ord")
    edges = cut(
        pairs.join(order.select(F.col("k").alias("a"), F.col("feed_ord").alias("oa")), "a")
        .join(order.select(F.col("k").alias("b"), F.col("feed_ord").alias("ob")), "b")
        .select(F.least("oa", "ob").alias("src"), F.greatest("oa", "ob").alias("dst"))
        .distinct()
    )
    if edges.isEmpty():
        return events.withColumn("fold", F.col("feed_ord"))
    labels = cu.propagate(edges)
    return events.join(labels.select(F.col("node").alias("feed_ord"), "label"), "feed_ord", "left").withColumn(
        "fold", F.coalesce("label", "feed_ord")
    ).drop("label")


def merge_event_feeds(events: DataFrame, scope: list[str] | None = None, same_id: bool = True) -> DataFrame:
    """DEDUP-3: fold the events of several feeds into one list per scope.

    ``feed_ord`` (long, unique) is the position in the concatenation of the feeds. Pairs
    are judged on the original events; equal ids always fold.
    """
    scope = scope or []
    events = cut(events.withColumn("event_key", F.col("feed_ord")))
    pairs = same_occurrence_edges(events, scope)
    if same_id:
        pairs = pairs.unionByName(consecutive(events, [*scope, "id"], "event_key")).distinct()
    folded = cut(_first_fit_groups(events, pairs, "event_key"))
    merged = merge_events(folded, "fold")
    if scope:
        merged = merged.join(folded.filter("fold = feed_ord").select("fold", *scope), "fold")
    return merged.withColumnRenamed("fold", "feed_ord")


# --- retention and country snapshots ------------------------------------------------------
def filter_retained_events(events: DataFrame, as_of, guard: bool = True) -> DataFrame:
    """FLT-9."""
    cutoff = ts(as_of) - F.expr(RETENTION)
    return events.filter(F.col("last_updated_at") >= (cutoff + F.expr(ROLLOVER_GUARD) if guard else cutoff))


def filter_ambiguous_country_events(events: DataFrame, overrides: DataFrame, gazetteer: DataFrame, key: str = "event_key", longest: int | None = None) -> DataFrame:
    """FLT-10: events of ambiguous countries must name an override term."""
    amb = F.broadcast(overrides.select(F.col("country").alias("country_name")).distinct().withColumn("_amb", F.lit(True)))
    tagged = events.join(amb, "country_name", "left")
    check = tagged.filter("_amb").select(key, "country_name", F.concat_ws(" ", event_text(), F.col("summary")).alias("text"))
    ok = (
        match_countries(check, gazetteer, key=key, longest=longest).withColumnRenamed("country", "country_name")
        .withColumn("_ok", F.lit(True))
    )
    return tagged.join(ok, [key, "country_name"], "left").filter("_amb is null or _ok").drop("_amb", "_ok")


def merge_country_snapshots(fresh: DataFrame, previous: DataFrame, as_of, overrides: DataFrame, gazetteer: DataFrame, longest: int | None = None) -> DataFrame:
    """DEDUP-5: per country fresh events folded with the previous ones, then FLT-9/10.

    Both inputs: event rows with country_name and feed_ord; fresh rows come first.
    """
    top = fresh.agg(F.coalesce(F.max("feed_ord") + 1, F.lit(0)).alias("m"))
    both = fresh.unionByName(
        previous.join(F.broadcast(top)).withColumn("feed_ord", F.col("feed_ord") + F.col("m")).drop("m")
    )
    merged = merge_event_feeds(both, ["country_name"])
    kept = filter_retained_events(merged, as_of, guard=False)
    return filter_ambiguous_country_events(kept, overrides, gazetteer, key="feed_ord", longest=longest)


def latest_feed_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """RANK-8: country_name, fresh_side, previous_side by newer updated_at; left wins ties."""
    sides = left.select("country_name", "updated_at", F.lit("left").alias("side")).unionByName(
        right.select("country_name", "updated_at", F.lit("right").alias("side"))
    )
    order = F.struct(newest("updated_at").alias("t"), F.col("side").alias("s"))
    return sides.groupBy("country_name").agg(
        F.min_by("side", order).alias("fresh_side"),
        F.when(F.count("*") > 1, F.max_by("side", order)).alias("previous_side"),
    )


def union_event_geography(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """AGG-4: per event id the union of affected countries over all feeds, then rescoring.

    ``mentions(id, affected_countries)`` are the event rows of every feed.
    """
    union = (
        mentions.select("id", F.explode("affected_countries").alias("c")).distinct()
        .groupBy("id").agg(F.sort_array(F.collect_set("c")).alias("_all"))
    )
    joined = events.join(union, "id", "left")
    rest = F.array_except(F.coalesce("_all", F.array().cast("array<string>")), F.col("affected_countries"))
    return regeo(joined, F.array_distinct(F.concat("affected_countries", rest))).drop("_all")


def _idents(both: DataFrame) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[c for c in ("iso2", "country_name") if c in both.columns])))


def _absorbed(both: DataFrame, near: DataFrame) -> DataFrame:
    """(fold, event_key): country events that a global event takes in because it affects their country.

    ``near`` (a, b) are those of one occurrence that share a country.
    """
    ident = _idents(both)
    tokens = tx.sorted_tokens(F.col("headline"))
    wide = cut(both.filter("side = 0").select(F.col("event_key").alias("fold"), "id", tokens.alias("tokens"), F.explode("affected_countries").alias("country")))
    own = cut(both.filter("side = 1").select("event_key", "id", tokens.alias("tokens"), F.explode(ident).alias("country")))
    by_id = wide.join(own, ["id", "country"]).select("fold", "event_key")
    worded = F.size("tokens") > 0
    by_tokens = wide.filter(worded).join(own.filter(worded), ["tokens", "country"]).select("fold", "event_key")
    by_report = near.select(F.col("a").alias("fold"), F.col("b").alias("event_key")).join(wide.select("fold", "country"), "fold").join(own.select("event_key", "country"), ["event_key", "country"])
    return by_id.unionByName(by_tokens).unionByName(by_report.select("fold", "event_key")).distinct()


def canonical_event_registry(global_events: DataFrame, country_events: DataFrame) -> DataFrame:
    """DEDUP-4: the registry of all views, one row per canonical event, with ``shown`` for the global list.

    Global events are seeds and never merge with each other. Each takes in the events of countries it affects that have
    its id or describe its occurrence, one country event possibly into several seeds. Then every country event folds
    into the first entry with its id or occurrence, a seed or an earlier country event, or opens an entry of its own.
    Pairs are judged on the original events (see ``merge_event_feeds``). Of seeds that share an id the last one is
    ``shown``; entries that country events opened are not.

    Both inputs carry feed_ord; global events have affected_countries, country events country_name (and iso2, if known).
    """
    top = global_events.agg(F.coalesce(F.max("feed_ord") + 1, F.lit(0)).alias("m"))
    tail = country_events.join(F.broadcast(top)).withColumn("feed_ord", F.col("feed_ord") + F.col("m")).drop("m")
    own = [c for c in ("country_name", "iso2") if c in tail.columns]
    cols = [c for c in global_events.columns if c in tail.columns and c not in own]
    both = global_events.select(*cols, *[F.lit(None).cast("string").alias(c) for c in own], F.lit(0).alias("side")).unionByName(
        tail.select(*cols, *own, F.lit(1).alias("side"))
    )
    both = cut(both.withColumn("event_key", F.col("feed_ord")))
    base = _worded(both, "event_key", [], "side", "affected_countries", *own)
    seed = F.col("side") == 0
    countries = F.filter(F.coalesce(F.when(seed, F.col("affected_countries")).otherwise(_idents(both)), F.array().cast("array<string>")), lambda c: c.isNotNull())
    rows = _headlines(base, "event_key", [], seed.alias("seed"), F.transform(countries, lambda c: F.xxhash64(c)).alias("countries"))
    edges, taken = sm.event_edges(rows, SAME_HOURS)
    equal = _equal(base, "event_key", [], True).unionByName(_with_first(both, ["id"], "event_key"))
    edges = edges.unionByName(equal.join(both.filter("side = 1").select(F.col("event_key").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    # the first of equal ids or tokens may be hidden behind a pair of seeds: then it is the first for both of them
    folded = cut(_first_fit_groups(both, edges, "event_key"))
    more = _absorbed(both, cut(taken)).join(folded.select("fold", "event_key"), ["fold", "event_key"], "left_anti")
    members = folded.unionByName(both.join(more, "event_key").select(*folded.columns))
    merged = merge_events(members, "fold")
    seeds = both.filter("side = 0").select("id", F.col("event_key").alias("fold"))
    last = seeds.groupBy("id").agg(F.max("fold").alias("fold")).select("fold", F.lit(True).alias("shown"))
    return merged.join(last, "fold", "left").withColumn("shown", F.coalesce("shown", F.lit(False))).withColumnRenamed("fold", "feed_ord")


# --- coverage of one event ----------------------------------------------------------------
def match_event_coverage(events: DataFrame, articles: DataFrame, key: str = "event_key", wide_stop_list: bool = False) -> DataFrame:
    """JOIN-9: distinct (key, id) of articles that report an event.

    A headline of n tokens needs at least r common ones, so an article that reports it has one of the headline's
    n - r + 1 rarest tokens. Only those meet article tokens in an equi-join; a token that many articles share
    makes candidates only where a headline has nothing rarer. The rule is then applied to the whole token lists.
    """
    tok = tx.coverage_tokens if wide_stop_list else tx.identity_tokens
    heads = F.array_distinct(F.concat(F.array("headline"), F.transform("articles", lambda a: a["headline"])))
    # equal token lists are judged once, however many events carry them
    named = events.select(key, F.explode(heads).alias("h")).select(key, F.sort_array(tok(F.col("h"))).alias("t")).filter(F.size("t") >= 2).distinct()
    lists = cut(named.select("t").distinct().select(F.monotonically_increasing_id().alias("head"), "t"))
    body = F.col("searchable_text") if "searchable_text" in articles.columns else F.concat_ws(" ", "title", "description")
    a = cut(articles.select("id", tok(body).alias("body")).filter(F.size("body") >= 2).withColumn("row", F.monotonically_increasing_id()))
    h = lists.select("head", F.size("t").alias("n"), F.explode("t").alias("tok"))
    inverted = a.select("row", F.explode("body").alias("tok"))
    frequency = inverted.join(small_side(h.select("tok").distinct()), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("f"))
    # the least number of common tokens that the rule below can accept
    needed = F.when(F.col("n") <= 3, 2).when(F.col("n") <= 7, 3).otherwise(4)
    order = Window.partitionBy("head").orderBy(F.coalesce("f", F.lit(0)), "tok")
    rare = h.join(frequency, "tok", "left").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("n") - needed + 1)
    met = inverted.join(small_side(cut(rare.select("head", "tok"))), "tok").select("head", "row").distinct()
    both = F.array_intersect("t", "body")
    s = (
        met.join(a, "row").join(small_side(lists), "head")
        .select("head", "id", F.size("t").alias("n"), both.alias("both"))
        .select("head", "id", "n", F.size("both").alias("s"), F.size(F.filter("both", lambda x: F.length(x) >= 6)).alias("d"))
    )
    share = F.col("s") / F.col("n")
    short = (F.col("s") >= 3) | ((F.col("s") >= 2) & (F.col("d") >= 1) & (share >= 0.66))
    long_ = (F.col("s") >= 4) | ((F.col("s") >= 3) & (share >= 0.4)) | ((F.col("s") >= 2) & (F.col("d") >= 1) & (share >= 0.5))
    hits = s.filter(F.when(F.col("n") <= 4, short).otherwise(long_)).select("head", "id").distinct()
    carriers = cut(lists.join(named, "t").select("head", key))
    return hits.join(small_side(carriers), "head").select(key, "id").distinct()


def enrich_events_with_coverage(events: DataFrame, articles: DataFrame, as_of, lexicon: dims.Lexicon, key: str = "event_key", top: int = 5) -> DataFrame:
    """JOIN-10: merge matching coverage into each event."""
    from newsloom.operators import classify as cl

    at = ts(as_of)
    events, articles = cut(events), ev.with_defaults(articles)
    matched = match_event_coverage(events, articles, key)
    # an article covers many events: only its number is kept with each of them
    rows = cl.classify_headlines(ev.with_publisher(articles), lexicon).withColumn("headline", F.col("title"))
    rows = cut(rows.select(*ev.ARTICLE_FIELDS, "description").withColumn("row", F.monotonically_increasing_id()))
    cover = cut(matched.join(rows.select("id", "row"), "id").select(key, "row"))
    fields = [key, *ev.ARTICLE_FIELDS]
    own = events.select(key, F.explode("articles").alias("x")).select(key, "x.*").select(*fields, F.lit(0).alias("side"))
    new = first_row(
        cover.join(rows.select("row", "publisher_key", "published_at", "id"), "row"), [key, "publisher_key"], [newest("published_at"), F.col("id")]
    ).select(key, "row")
    new = new.join(rows.drop("description"), "row").select(*fields, F.lit(1).alias("side"))
    ratings = F.create_map(*[F.lit(v) for k, b, _ in dims.PUBLISHER_RATINGS for v in (k, b)])
    one = first_row(own.unionByName(new), [key, "publisher_key"], [newest("published_at"), F.col("side"), F.col("id")]).withColumn(
        "bucket", F.try_element_at(ratings, F.col("publisher_key"))
    )
    spread = one.groupBy(key).agg(F.count("*").alias("_n"), F.min("published_at").alias("_lo"), F.max("published_at").alias("_hi"))
    window, rate = ev.reporting(F.col("_lo"), F.col("_hi"), F.col("_n"))
    visible = pub.balanced_top_sources(
        one.join(events.select(key, F.col("category").alias("_cat")), key), [key], top, pub.shows_perspective(F.col("_cat"))
    )
    lists = visible.groupBy(key).agg(ev.sorted_articles([F.col("rank")]).alias("_articles"))
    heads = events.select(key, "headline", F.col("summary").alias("_old"))
    texts = rows.select("row", "description", "published_at", "id")
    summaries = ev.choose_shared_summary(cover, texts, heads, key, F.col("_old")).withColumnRenamed("summary", "_summary")
    out = events.join(spread, key, "left").join(lists, key, "left").join(summaries, key, "left").withColumns({
        "independent_source_count": F.greatest("independent_source_count", "_n").cast("long"),
        "age_hours": F.least("age_hours", F.greatest(F.lit(0.0), ev.hours_between(at, F.col("_hi")))),
        "article_count": F.greatest("article_count", "_n").cast("long"),
        "coverage_window_hours": F.greatest("coverage_window_hours", window),
        "articles_per_hour": F.greatest("articles_per_hour", rate),
        "articles": F.coalesce("_articles", "articles"),
        "summary": F.col("_summary"),
    })
    out = out.withColumn("matched_publisher_count", F.col("independent_source_count"))
    return ev.score_events(out).drop("_n", "_lo", "_hi", "_articles", "_summary")
