"""Grouping idioms that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(c: str | Column) -> Column:
    """Ascending sort key that puts later timestamps first and missing ones last."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(-F.unix_micros(c), F.lit(2**62))


def highest(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(-c.cast("double"), F.lit(float("inf")))


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; combines map-side, so no hot task."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key (all with None); the limit is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def sliced_row_number(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], name: str) -> DataFrame:
    """``row_number`` per key without one task per key.

    ``slice_`` must grow with ``order``. Rows are numbered inside each (key, slice) and
    shifted by the number of rows in the earlier slices of the key.
    """
    df = df.withColumn("_slice", slice_)
    sizes = df.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice").eqNullSafe(F.col("_s"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        df.withColumn("_in", F.row_number().over(inside))
        .join(sizes, cond, "inner")
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
        .drop("_slice", "_in", "_before", "_s", *[f"_k{i}" for i in range(len(keys))])
    )


def consecutive(df: DataFrame, keys: list[str], pos: str, slice_rows: int = 4096) -> DataFrame:
    """(a, b): neighbouring ``pos`` values of each key, found per slice and across slices."""
    rows = df.select(*keys, pos, F.floor(F.col(pos) / slice_rows).alias("_s"))
    inside = Window.partitionBy(*keys, "_s").orderBy(pos)
    within = rows.select(F.lag(pos).over(inside).alias("a"), F.col(pos).alias("b"))
    slices = rows.groupBy(*keys, "_s").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_s")
    across = slices.select(F.lag("_last").over(order).alias("a"), F.col("_first").alias("b"))
    return within.unionByName(across).filter("a is not null")


def paged(rows: DataFrame, keys: list[str], slice_: Column, order: list[Column], item: Column, page_rows: int) -> DataFrame:
    """(keys, page from 0, items): the rows of each key in ``order``, at most ``page_rows`` to a page.

    Rows are numbered per slice, so neither a task nor a row ever holds a whole key.
    """
    numbered = sliced_row_number(rows, keys, slice_, order, "_at")
    page = F.floor((F.col("_at") - 1) / page_rows).cast("long")
    pairs = F.collect_list(F.struct(F.col("_at").alias("at"), item.alias("item")))
    return numbered.groupBy(*keys, page.alias("page")).agg(F.transform(F.sort_array(pairs), lambda p: p["item"]).alias("items"))


def complete_pages(directory: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``directory`` with the pages of each key and how many items and pages it has; a key without any has one empty page."""
    totals = pages.groupBy(*keys).agg(F.sum(F.size("items")).cast("long").alias("total"), F.count("*").alias("n_pages"))
    empty = F.array().cast(pages.schema["items"].dataType)
    out = directory.join(totals, keys, "left").join(pages, keys, "left")
    return out.withColumns({
        "page": F.coalesce("page", F.lit(0).cast("long")), "items": F.coalesce("items", empty),
        "total": F.coalesce("total", F.lit(0).cast("long")), "n_pages": F.coalesce("n_pages", F.lit(1).cast("long")),
    })
