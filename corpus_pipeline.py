"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it gets, and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs. All but the last keep the columns of documents.

1. language: rows whose text is in no learned language (``und``) go; a text may mix any of them.
2. near_dedup: of each group of near copies (five words a shingle, similarity of ``SIMILAR`` percent or more) one row stays,
   that with the smallest (doc_id, text); copies of a text under one id are one.
3. decontaminate: rows whose own text contains a benchmark item go.
4. secrets: secrets are replaced in the texts; no document goes, n_chars follows the text.
5. packing: the texts as packed sequences of 2048 ids.

Rows are told apart by id and text, so an id may repeat or be null; a row with a null doc_id is never a near copy and stays
until a stage rejects its text. Further columns are kept, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, hyperminhash, langid, packing, secrets
from newsloom.llm.queries import tokenizer_path
from newsloom.llm.runtime import Scratch, fresh, id_crc, read

SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(fresh(docs, c) for c in ("lang", "share", "languages"))
    judged = langid.identify(docs, id_crc() % 4 != 2, docs.columns, names)
    return judged.where(judged[names[0]] != "und").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicate(docs, SIMILAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", without_secrets), ("packing", packed)]

# Tokenization and language models can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
