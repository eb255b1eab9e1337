"""A training corpus out of raw documents: language, near copies, repeated passages, packed windows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladefreq.llm.common import discard, ship, stored
from cladefreq.llm.language_id import identify
from cladefreq.llm.near_dedup import drop_near_duplicates
from cladefreq.llm.packing import pack
from cladefreq.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model knows; `lang` becomes the prediction. Learns from the labelled documents.

    Null texts and texts without a letter go, as no language can be told. Repeated rows and ids are judged row by row; very
    long texts are read whole; an empty table, or one without labels, gives no rows. Only the columns of documents are
    returned, so names of others cannot clash.
    """
    ship(spark)
    found = identify(docs, F.lit(True)).where(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; null ids count as larger than all others.

    Null and empty texts all stay. Of rows with one id and text one stays; rows that share an id with other texts are
    documents of their own. Very long texts are compared whole; an empty table gives no rows.
    """
    ship(spark)
    return drop_near_duplicates(docs, 0.8).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that a document of a smaller id holds.

    Characters of which only a part was removed go whole; null texts stay null, with a null n_chars. Rows that share an id
    don't remove from each other; null ids count as larger than all others. Very long texts are searched whole; an empty
    table gives no rows.
    """
    ship(spark)
    found = remove_repeats(docs, 50)
    length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", length).select(*COLUMNS)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 4096 ids, one row per piece with its ids.

    Null texts count as empty and still have their end id; repeated rows and ids are packed like any others, very long texts
    in several pieces; an empty table gives no rows.
    """
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed_windows),
]

#: SQL has neither the language models nor differencing; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored in the shared folder and read again; the next one's output replaces it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        docs, before = after, [after]
    return docs
