"""What the operators share on the driver: shipping code, scratch tables, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    package = os.path.dirname(here)
    root = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-ship-"), "llm_operators.zip")
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr(f"{root}/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"{root}/{os.path.basename(here)}/{name}")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables that cut lineage, below the shared folder; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def bytes(self, df: DataFrame) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def small(self, df: DataFrame, limit: int = 4 << 20) -> DataFrame:
        """A broadcast hint if the written table is below ``limit`` bytes; else a shuffle join stays."""
        return F.broadcast(df) if self.bytes(df) <= limit else df


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: longer than any of its names."""
    return f"_{name}_{'_' * max(map(len, df.columns))}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
