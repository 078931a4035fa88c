"""From raw documents to packed training sequences, stage by stage.

What every stage does with hard rows: empty tables give empty ones; columns besides those of documents pass through up to the last
stage, whatever their names; rows of one text and doc_id are each a row, as is a row with a null doc_id; nulls in lang and
source pass through; very long texts are used whole. Where a stage does more, its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import minhash, mixing, packing, quality_rules, substring
from sparkloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleans lines; documents that lose too much text go, and so do null, empty and blank texts. Repeated rows are each judged."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near duplicates, which settles ties. Null texts, texts without words and null doc_ids are in no group and stay; repeated rows of one doc_id go or stay together."""
    return minhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of passages of 50 words or more, in order of doc_id and position; a document of which nothing is left goes. Null texts and null doc_ids stay as they are."""
    return substring.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects and repeats documents to meet the sources' target weights. Null and empty texts have no words and come with whole copies only; documents in no source go; rows that tie in the seeded order are taken together or not at all."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: bin_id, doc_id, start_word, n_words, bin_offset. Texts without words are in no bin; a null doc_id stays null; ties go by doc_id and start; other columns end here."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: MinHash, the flow and the packing's tree can't be put into SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
