"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Settings every session of the library runs with.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialized intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a folder of its own; anywhere else a machine-local folder would be lost together
    with its executor, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="newsloom-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """``df.select(*columns)`` with every expression computed once per row.

    A filter on a projected column repeats the column's whole expression below the projection, as often as the filter names
    it; filters don't pass a generator.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def ts(value: str | dt.datetime | Column) -> Column:
    """An ``as_of`` argument as a timestamp column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.to_timestamp(F.lit(value))
    return F.lit(value).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours as a double, with microsecond resolution."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def is_small(df: DataFrame, max_bytes: int = 16 << 20) -> bool:
    """Whether the rows of ``df``, measured as text, take no more than ``max_bytes``."""
    return (df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) <= max_bytes


def small_side(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Broadcast a dimension only after measuring its rows; larger ones stay a shuffle join."""
    return F.broadcast(df) if is_small(df, max_bytes) else df
