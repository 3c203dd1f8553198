"""All registered queries and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.session import SETTINGS
from checks import corpus as c, queries_base as base, queries_geo, queries_more  # noqa: F401


def apply_settings(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def _configured(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, sf)

    return run


def _all():
    return base.CASES, base.SQL


def queries():
    return {name: _configured(fn) for name, fn in _all()[0].items()}


def oracle_sql():
    return dict(_all()[1])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.events import build_events
    from newsloom.operators.serving import rank_events

    apply_settings(spark)
    from pyspark.sql import functions as F

    events = build_events(c.articles(spark, sf), c.AS_OF, c.LEX)
    return rank_events(events.withColumn("event_id", F.col("id")))
