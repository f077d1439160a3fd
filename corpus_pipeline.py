"""Training corpus from raw documents, in stages; each is written as Parquet and reread as the next one's documents.

A document is a row: no stage goes by doc_id, so rows that repeat one, or have none, are documents of their own, judged by
their texts. A null or empty text has no language and goes in the first stage; alone, the later stages define it as their
operators do. An empty table gives an empty table, and columns beside those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.llm.decontaminate import decontaminated
from epochlake.llm.language import identify, learn
from epochlake.llm.mixing import mix, sequence
from epochlake.llm.packing import pack
from epochlake.llm.queries import table, tokenizer_file
from epochlake.llm.shared import Scratch
from epochlake.llm.weighted_minhash import deduplicated

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; lang becomes the language found. Learned from all labelled ones.

    Null and empty texts, and those without a letter, go; so do all where no label is given. Equal rows are judged alike.
    """
    told = identify(docs.select(*COLUMNS), learn(docs)).where("not rejected")
    return told.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the least doc_id, nulls last; of rows with equal ones, one.

    Rows with null or blank texts are never duplicates of each other and stay.
    """
    return deduplicated(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts contain no benchmark item, copied or paraphrased. Null and empty texts contain none."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, whole, as often as their source's target takes them. Written as Parquet, that order
    is the order of files by name and of rows in a file. Null and empty texts have no words and are not taken."""
    mixed = Scratch(spark, "mixed").keep(mix(docs.select(*COLUMNS)).where("taken > 0"), "docs")  # the files of its shuffle go before the next
    return sequence(mixed).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids, in the order of the stored documents, with neighbours in training next to each other."""
    stored = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    return pack(stored, tokenizer_file("byte_bpe_50k.tiktoken"), order=("file", "place"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("pack_tokens", pack_tokens),
]

#: Most stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
