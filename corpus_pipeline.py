"""From raw documents to packed training sequences: quality rules, near-duplicates, secrets, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages up to the last return
the columns of docs, whatever their names, so each can be written and read again before the next. An empty table gives an empty one in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import mixing, packing, quality_rules, secrets, simhash
from offerlens.llm.common import read
from offerlens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; none goes for its size.

    A null or blank text has no words and goes; rows are judged one by one, repeated ones and those without a doc_id like any.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id.

    Rows without a doc_id all stay, as none can be told to stand for another. Of rows that share the doc_id that stays, the one with the least text
    stays (null first): an id is one document. Null and blank texts are copies of one another.
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars is counted anew where something was.

    A null text stays null; repeated rows and rows without a doc_id are masked like any; texts of any length are masked whole.
    """
    return secrets.redact(docs, tokenizer_path(secrets.VOCABULARY))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows; one that it doesn't take goes.

    A text without a word has nothing to take and goes; rows that share a doc_id are taken alike, those without one as one more id; a null source is
    a source of its own, the last.
    """
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences.

    A null or empty text is its end alone, one token; repeated rows are pieces of their own; a doc_id may be null; texts of any length are cut into pieces and lose nothing.
    """
    return packing.pack(docs, tokenizer_path(packing.TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Hash thresholds, fingerprints and tokenizers have no SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
