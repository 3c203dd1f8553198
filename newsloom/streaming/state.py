"""STREAM-3 state: keyed upserts in runs under a commit log.

A batch writes one run with its own valid rows only, and a version that appends the run, so what it writes grows with the
batch and not with the state. Reading merges the runs: of a country's article key the row of the newest run counts, then
stories leave by age. When a version has ``compact_after`` runs, they are merged into one, expired rows are left out, and runs
that were appended meanwhile stay behind it. Two writers at once lose nothing: the later one appends to the other's version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.operators.countries import filter_relevant_to_country
from newsloom.operators.feeds import article_key
from newsloom.operators.grouping import first_row, newest
from newsloom.operators.quality import filter_current, filter_event_titles
from newsloom.sources.commits import CommitLog

COMPACT_AFTER = 16
KEEP = 3
KEYS = ["country_name", "article_key"]


class CountryState:
    def __init__(self, spark: SparkSession, root: str, schema: str, compact_after: int = COMPACT_AFTER, keep: int = KEEP):
        self.spark, self.log, self.compact_after, self.keep = spark, CommitLog(root), compact_after, keep
        self.columns = spark.createDataFrame([], schema).schema
        self.stored = StructType([f for f in self.columns if f.name != "article_key"] + [StructField("article_key", StringType())])

    def _run(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.log.run_path(run))

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = None
        for age, run in enumerate(reversed(runs)):
            part = self._run(run).withColumn("_age", F.lit(age))
            rows = part if rows is None else rows.unionByName(part)
        return first_row(rows, KEYS, [F.col("_age"), newest("published_at"), F.col("id")]).drop("_age")

    def read(self, as_of) -> DataFrame:
        """The current stories of every country."""
        _, entry = self.log.latest()
        names = self.columns.names
        if not entry.get("runs"):
            return self.spark.createDataFrame([], self.columns)
        return filter_current(self._merged(entry["runs"]), as_of).select(*names)

    def upsert(self, batch: DataFrame, as_of, gazetteer: DataFrame | None = None, rules: DataFrame | None = None, longest: int | None = None) -> int:
        """Fold a batch in and return the version; an empty batch, or one without a valid row, changes nothing."""
        rows = filter_event_titles(filter_current(batch, as_of))
        if gazetteer is not None:
            rows = filter_relevant_to_country(rows.withColumn("broad_feed", F.lit(False)), gazetteer, rules, longest).drop("broad_feed")
        rows = first_row(rows.withColumn("article_key", article_key()), KEYS, [newest("published_at"), F.col("id")])
        run = uuid.uuid4().hex
        rows.select(*self.stored.names).write.parquet(self.log.run_path(run))
        if self._run(run).isEmpty():
            return self.log.latest()[0]
        version = self.log.append(lambda entry: {"runs": [*entry.get("runs", []), run]})
        if len(self.log.entry(version)["runs"]) >= self.compact_after:
            version = self.compact(as_of)
        self.log.expire(self.keep)
        return version

    def compact(self, as_of) -> int:
        """Merge the runs of the latest version into one; rows that are no longer current go."""
        version, entry = self.log.latest()
        merged, run = entry["runs"], uuid.uuid4().hex
        filter_current(self._merged(merged), as_of).write.parquet(self.log.run_path(run))

        def change(now: dict) -> dict:
            # another writer may have compacted in between: then its result stands
            return {"runs": [run, *now["runs"][len(merged):]]} if now["runs"][: len(merged)] == merged else now

        return self.log.append(change)
