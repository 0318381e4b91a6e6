"""The operators as registered queries: op1_ to op13_."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import avi, bpe, chat, fim, licenses, near, packing, pages, pii, quality, spelling, spots, warc
from tilewright.llm.common import table


def vocabulary() -> str:
    """The path of the tokenizer file of the installed public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digest(table(spark, sf_dir, "documents"))


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op9_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.digest(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], conversations.schema)
    return chat.digest(conversations.unionByName(extra))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_avi": op1_avi,
    "op2_pages": op2_pages,
    "op3_licenses": op3_licenses,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_near": op7_near,
    "op8_bpe": op8_bpe,
    "op9_spots": op9_spots,
    "op10_chat": op10_chat,
    "op11_warc": op11_warc,
    "op12_fim": op12_fim,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op11_warc": warc.ORACLE, "op12_fim": fim.ORACLE, "op13_spelling": spelling.ORACLE}
