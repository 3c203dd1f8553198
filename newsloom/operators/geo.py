"""JOIN-14/15/19, AGG-12/13, GRAPH-1, VIEW-1: polygons, markers and event links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import scoring
from newsloom.functions.text import let
from newsloom.operators.grouping import first_row, highest
from newsloom.session import small_side

EPS = 1e-9
CELL = 10


def normalize_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def unwrap(ring: Column) -> Column:
    """Longitudes made continuous across the antimeridian.

    Only the few steps that cross it are folded: a vertex is moved by the turns up to it, so the work is linear
    in the vertices and nothing is copied per step.
    """

    def whole(pts: Column) -> Column:
        def turn(i: Column) -> Column:
            d = F.get(pts, i)["lon"] - F.get(pts, i - 1)["lon"]
            return F.struct(i.alias("at"), F.when(d > 180, -360.0).when(d < -180, 360.0).otherwise(0.0).alias("by"))

        def moved(turns: Column) -> Column:
            by = lambda i: F.aggregate(turns, F.lit(0.0), lambda s, t: s + F.when(t["at"] <= i, t["by"]).otherwise(0.0))
            return F.transform(pts, lambda p, i: F.struct((p["lon"] + by(i)).alias("lon"), p["lat"].alias("lat")))

        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pts) - 1, F.lit(0))), turn)
        return let(F.filter(steps, lambda t: t["by"] != 0), moved)

    return let(ring, whole)


def prepare_polygons(polygons: DataFrame) -> DataFrame:
    """Rings unwrapped, holes shifted next to their outer ring, bounds added.

    ``polygons(ord, country_id, name, polygon_id, ring_id, ring)``; ring 0 is the outer
    one. One output row per polygon with ``rings`` in order.
    """
    rings = (
        polygons.filter((F.size("ring") >= 3) & (F.trim("name") != "")).withColumn("ring", unwrap(F.col("ring")))
        .withColumn("lo", F.array_min(F.transform("ring", lambda p: p["lon"])))
        .withColumn("hi", F.array_max(F.transform("ring", lambda p: p["lon"])))
    )
    outer = rings.groupBy("polygon_id").agg(
        F.min_by(F.struct("ord", "country_id", "name", "lo", "hi", "ring"), "ring_id").alias("o"), F.min("ring_id").alias("first_ring")
    )
    joined = rings.select("polygon_id", "ring_id", "ring", F.col("lo").alias("rlo"), F.col("hi").alias("rhi")).join(outer, "polygon_id")
    shift = F.when(F.col("ring_id") == F.col("first_ring"), 0.0).otherwise(
        F.floor(((F.col("o.lo") + F.col("o.hi")) / 2 - (F.col("rlo") + F.col("rhi")) / 2) / 360 + 0.5) * 360
    )
    moved = joined.withColumn("s", shift).withColumn(
        "ring", F.transform("ring", lambda p: F.struct((p["lon"] + F.col("s")).alias("lon"), p["lat"].alias("lat")))
    )
    return moved.groupBy("polygon_id").agg(
        F.first("o.ord").alias("ord"), F.first("o.country_id").alias("country_id"), F.first("o.name").alias("name"),
        F.first("o.lo").alias("lon_lo"), F.first("o.hi").alias("lon_hi"),
        F.first(F.array_min(F.transform("o.ring", lambda p: p["lat"]))).alias("lat_lo"),
        F.first(F.array_max(F.transform("o.ring", lambda p: p["lat"]))).alias("lat_hi"),
        F.transform(F.sort_array(F.collect_list(F.struct("ring_id", "ring"))), lambda r: r["ring"]).alias("rings"),
    )


def _cells(lon_lo: Column, lon_hi: Column, lat_lo: Column, lat_hi: Column) -> Column:
    def hits(i: Column) -> Column:
        west = (i * CELL - 180).cast("double")
        touch = lambda w: (w <= lon_hi + EPS) & (w + CELL >= lon_lo - EPS)
        return touch(west) | touch(west - 360) | touch(west + 360)

    band = lambda lat: F.least(F.lit(17), F.greatest(F.lit(0), F.floor((lat + 90) / CELL).cast("int")))
    lons = F.filter(F.sequence(F.lit(0), F.lit(35)), hits)
    lats = F.sequence(band(lat_lo), band(lat_hi))
    return F.flatten(F.transform(lats, lambda y: F.transform(lons, lambda x: x + y * 36)))


def _locate(lon: Column, lat: Column, ring: Column) -> Column:
    """0 outside, 1 inside, 2 on the boundary."""
    n = F.size(ring)
    edges = F.zip_with(F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, n - 1)), ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def touches(e: Column) -> Column:
        dx, dy = e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]
        px, py = lon - e["a"]["lon"], lat - e["a"]["lat"]
        sq, dot = dx * dx + dy * dy, px * dx + py * dy
        near = (px * px + py * py) <= EPS**2
        on = (F.abs(px * dy - py * dx) <= EPS) & (dot >= -EPS) & (dot <= sq + EPS)
        return F.when(sq <= EPS**2, near).otherwise(on)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (b["lat"] > lat) != (a["lat"] > lat)
        x = (a["lon"] - b["lon"]) * (lat - b["lat"]) / F.nullif(a["lat"] - b["lat"], F.lit(0.0)) + b["lon"]
        return straddles & (lon < x)

    return let(edges, lambda es: F.when(F.exists(es, touches), 2).otherwise(F.size(F.filter(es, crosses)) % 2))


def _in_box(lon: Column, lat: Column) -> Column:
    return (
        (lon >= F.col("lon_lo") - EPS) & (lon <= F.col("lon_hi") + EPS)
        & (lat >= F.col("lat_lo") - EPS) & (lat <= F.col("lat_hi") + EPS)
    )


def _inside(lon: Column, lat: Column) -> Column:
    """Point test against the polygon columns of a joined row."""
    outer = _locate(lon, lat, F.col("rings")[0])
    holes = F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(1))), lambda r: _locate(lon, lat, r))
    first_hit = F.try_element_at(F.filter(holes, lambda h: h > 0), F.lit(1))
    in_hole = F.coalesce(first_hit, F.lit(0)) == 1
    return _in_box(lon, lat) & ((outer == 2) | ((outer == 1) & ~in_hole))


def points_in_polygons(points: DataFrame, prepared: DataFrame, key: str = "id") -> DataFrame:
    """JOIN-15: (key, lon, lat, country_id, name) of the first containing polygon, else null.

    Points meet the bounds of polygons in an equi-join on 10-degree cells; rings are joined by polygon only for
    points inside the bounds. Each side of polygons is broadcast if its measured size allows; beyond that a
    crowded cell or polygon is left to the adaptive skew join.
    """
    lon = normalize_longitude(F.col("lon"))
    ok = ~F.isnan("lon") & ~F.isnan("lat") & F.col("lon").isNotNull() & F.col("lat").between(-90, 90) & (F.abs("lon") < float("inf"))
    x = F.least(F.lit(35), F.greatest(F.lit(0), F.floor((lon + 180) / CELL).cast("int")))
    y = F.least(F.lit(17), F.greatest(F.lit(0), F.floor((F.col("lat") + 90) / CELL).cast("int")))
    pts = points.withColumn("cell", F.when(ok, x + y * 36)).withColumn("nlon", F.when(ok, lon))
    bounds = ["lon_lo", "lon_hi", "lat_lo", "lat_hi"]
    cells = prepared.select("polygon_id", *bounds, F.explode(_cells(*[F.col(c) for c in bounds])).alias("cell"))
    n = F.col("nlon")
    around = lambda test: test(n, F.col("lat")) | test(n - 360, F.col("lat")) | test(n + 360, F.col("lat"))
    near = pts.select(key, "nlon", "lat", "cell").join(small_side(cells), "cell").filter(around(_in_box))
    rings = prepared.select("polygon_id", "ord", "country_id", "name", "rings")
    hit = near.join(small_side(rings), "polygon_id").filter(around(_inside))
    best = hit.groupBy(key).agg(F.min_by(F.struct("country_id", "name"), F.struct("ord", "polygon_id")).alias("_b"))
    return points.join(best, key, "left").select(*points.columns, F.col("_b.country_id").alias("country_id"), F.col("_b.name").alias("name"))


def polygon_centers(polygons: DataFrame) -> DataFrame:
    """AGG-13: country_id, name, lon, lat of the largest outer ring's planar centroid.

    Vertices become rows, edges come from a window per ring, and the shoelace sums are
    plain aggregates.
    """
    outer = polygons.filter((F.col("ring_id") == 0) & (F.trim("name") != ""))
    pts = outer.select("ord", "country_id", "name", "polygon_id", F.posexplode(unwrap(F.col("ring"))).alias("i", "p"))
    pts = pts.select("ord", "country_id", "name", "polygon_id", "i", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
    w = Window.partitionBy("polygon_id").orderBy("i")
    whole = Window.partitionBy("polygon_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pts = pts.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn(
        "ny", F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    )
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    ring = pts.groupBy("polygon_id").agg(
        F.first("ord").alias("ord"), F.first("country_id").alias("country_id"), F.first("name").alias("name"),
        F.sum(cross).alias("a2"), F.sum((F.col("x") + F.col("nx")) * cross).alias("sx"),
        F.sum((F.col("y") + F.col("ny")) * cross).alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    flat = F.abs("a2") < 0.000001
    ring = ring.withColumns({
        "area": F.when(flat, 0.0).otherwise(F.abs(F.col("a2") / 2)),
        "cx": F.when(flat, F.col("mx")).otherwise(F.col("sx") / (3 * F.col("a2"))),
        "cy": F.when(flat, F.col("my")).otherwise(F.col("sy") / (3 * F.col("a2"))),
    })
    best = first_row(ring.select("name", "country_id", "area", "cx", "cy", "ord", "polygon_id"), ["name"], [highest("area"), F.col("ord"), F.col("polygon_id")])
    return best.select("country_id", "name", normalize_longitude(F.col("cx")).alias("lon"), F.col("cy").alias("lat"))


def locate_country_markers(countries: DataFrame, capitals: DataFrame, centers: DataFrame) -> DataFrame:
    """JOIN-14: marker rows: capitals by ISO-2, else by ISO-3, else the polygon centre.

    ``countries(name, map_id, iso2, iso3, category, importance_score)``.
    """
    caps = capitals.select("iso2", "iso3", "capital", "lat", "lng")
    a = countries.join(small_side(caps.drop("iso3")), "iso2")
    rest = countries.join(a.select("name").distinct(), "name", "left_anti")
    b = rest.join(small_side(caps.drop("iso2")), "iso3")
    rest = rest.join(b.select("name").distinct(), "name", "left_anti")
    by_name = small_side(centers.select("name", F.col("lon").alias("l1"), F.col("lat").alias("a1")))
    by_id = small_side(centers.select(F.col("country_id").alias("map_id"), F.col("lon").alias("l2"), F.col("lat").alias("a2")))
    c = (
        rest.join(by_name, "name", "left").join(by_id, "map_id", "left")
        .withColumns({"lng": F.coalesce("l1", "l2"), "lat": F.coalesce("a1", "a2"), "capital": F.col("name")})
        .filter("lng is not null").drop("l1", "l2", "a1", "a2")
    )
    cols = [*countries.columns, "capital", "lat", "lng"]
    rows = a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols))
    one = first_row(rows, ["name", "lat", "lng"], [F.col("capital")])
    color = F.when(F.col("category").isNull(), F.lit(dims.COLOR_MARKER_NO_EVENT)).otherwise(
        scoring.fill_color(F.col("category"), F.col("importance_score"))
    )
    return one.withColumn("color", color).orderBy(F.desc(F.coalesce("importance_score", F.lit(0))), "name", "capital")


def style_country_table(geometry: DataFrame, countries: DataFrame, selected: str | None = None) -> DataFrame:
    """JOIN-19 + VIEW-1: fill colour and opacity per geometry row, by id or else by name.

    ``countries(map_id, name, category, importance_score, signal_ready)``.
    """
    pick = lambda p: F.struct("map_id", "name", "category", "importance_score", "signal_ready").alias(p)
    by_id = small_side(countries.select(F.col("map_id").alias("country_id"), pick("_i")))
    by_name = small_side(countries.select(F.col("name").alias("geo_name"), pick("_n")))
    g = geometry.withColumn("geo_name", F.trim("name")).drop("name").join(by_id, "country_id", "left").join(by_name, "geo_name", "left")
    g = g.withColumn("c", F.coalesce("_i", "_n"))
    none = F.col("c.category").isNull()
    color = (
        F.when(F.col("c").isNull(), F.lit(dims.COLOR_UNKNOWN_COUNTRY))
        .when(none & (F.col("c.signal_ready") == F.lit(False)), F.lit(dims.COLOR_NOT_READY))
        .when(none, F.lit(dims.COLOR_NO_EVENT))
        .otherwise(scoring.fill_color(F.col("c.category"), F.col("c.importance_score")))
    )
    is_selected = F.coalesce(F.col("c.map_id") == F.lit(selected), F.lit(False))
    return g.select(
        "country_id", F.coalesce("c.map_id", F.lit("")).alias("map_id"), F.coalesce("c.name", "geo_name").alias("name"),
        color.alias("color"), F.when(is_selected, 0.68).when(~none & F.col("c").isNotNull(), 0.46).otherwise(0.28).alias("opacity"),
    )


def strongest_country_links(
    events: DataFrame, mentions: DataFrame, countries: DataFrame, selected: str | None = None, max_links: int = 28
) -> DataFrame:
    """AGG-12: strongest event per unordered country pair, top ``max_links``.

    ``events(event_id, ord, category, headline, importance_score, primary_country)``,
    ``mentions(event_id, country)``, ``countries(ord, name, map_id, iso2, lon, lat)`` with
    a centre. The origin of an event is the selected country, else its primary country,
    else the first mentioned one; each event yields one edge per other country.
    """
    c = small_side(countries.filter("lon is not null").select(
        F.col("name").alias("country"), F.col("ord").alias("c_ord"), "map_id", "iso2", "lon", "lat"
    ))
    m = mentions.join(c, "country").join(events.select("event_id", "primary_country"), "event_id")
    role = (
        F.when(F.col("map_id") == F.lit(selected), 0)
        .when((F.col("iso2") == F.col("primary_country")) | (F.col("country") == F.col("primary_country")), 1)
        .otherwise(2)
    )
    origin = m.groupBy("event_id").agg(
        F.min_by(F.struct("country", "map_id", "lon", "lat"), F.struct(role.alias("r"), F.col("c_ord").alias("o"))).alias("o"),
        F.count("*").alias("n"),
    ).filter("n >= 2")
    edges = m.join(origin, "event_id").filter("map_id <> o.map_id").join(
        events.select("event_id", F.col("ord").alias("e_ord"), "category", "headline", "importance_score"), "event_id"
    ).select(
        "event_id", "e_ord", "category", "headline", "importance_score",
        F.col("o.country").alias("from"), F.col("country").alias("to"),
        F.col("o.lon").alias("from_lon"), F.col("o.lat").alias("from_lat"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), "c_ord",
        F.least("o.country", "country").alias("p1"), F.greatest("o.country", "country").alias("p2"),
    )
    best = first_row(edges, ["p1", "p2"], [highest("importance_score"), F.col("e_ord"), F.col("c_ord")])
    out = best.orderBy(F.desc("importance_score"), "e_ord", "c_ord").limit(max_links)
    colors = F.create_map(*[F.lit(x) for kv in dims.CATEGORY_COLORS.items() for x in kv])
    return out.withColumn("color", F.try_element_at(colors, F.col("category"))).drop("p1", "p2", "e_ord", "c_ord")


def event_link_paths(links: DataFrame, steps: int = 36) -> DataFrame:
    """GRAPH-1: a quadratic curve of ``steps`` + 1 points per link, bent away from the equator."""
    x0, y0, x1, y1 = F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")
    dx, dy, mid = x1 - x0, y1 - y0, (y0 + y1) / 2
    scaled = dx * F.cos(mid * (math.pi / 180))
    distance = F.sqrt(scaled * scaled + dy * dy)
    bend = F.least(F.lit(18.0), F.greatest(F.lit(2.5), distance * 0.16))
    length = F.greatest(F.lit(0.001), F.sqrt(dx * dx + dy * dy))
    side = F.when(mid >= 0, 1.0).otherwise(-1.0)
    df = links.withColumns({
        "_cx": (x0 + x1) / 2 - dy / length * bend * side,
        "_cy": (y0 + y1) / 2 + dx / length * bend * side,
    })

    def point(i: Column) -> Column:
        t = i / F.lit(float(steps))
        u = 1.0 - t
        at = lambda a, c, b: u * u * a + 2.0 * u * t * c + t * t * b
        return F.struct(at(x0, F.col("_cx"), x1).alias("lon"), at(y0, F.col("_cy"), y1).alias("lat"))

    return df.withColumn("path", F.transform(F.sequence(F.lit(0), F.lit(steps)), point)).drop("_cx", "_cy")
