"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import ann, bitpack, chat, decontaminate, hyperminhash, langid, licenses, ngram_lm, packing, prefix_trie, repair, secrets, toxicity
from newsloom.llm.runtime import id_crc, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(read(spark, sf_dir, "documents"), id_crc() % 7 != 2)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    return chat.round_trip(table.unionByName(own))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), id_crc() % 5 != 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", id_crc() % 4 == 2)
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(read(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontaminate, op2_ngram_lm, op3_secrets, op4_chat, op5_toxicity, op6_langid, op7_ann, op8_packing, op9_bitpack, op10_hyperminhash, op11_licenses, op12_repair, op13_prefix_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE_SQL, "op12_repair": repair.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
