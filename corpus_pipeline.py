"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of documents. All but the last return
those columns again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.line_dedup import dedup_lines
from tallyloom.llm.ngram_join import drop_near_copies
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality import keep_good
from tallyloom.llm.shared import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or as toxic, go; ids are unique here."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and with them documents of which nothing but blank lines is left; n_chars follows the text."""
    cleaned = dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & (F.regexp_replace("text", r"[\x20\x09-\x0D]", "") == "")
    return cleaned.filter(~F.coalesce(empty, F.lit(False))).select(
        "doc_id", "text", "lang", "source", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")).alias("n_chars")
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five words, a similarity of 0.8."""
    return drop_near_copies(docs, words=5, percent=80).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their ids, placed in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packing),
]

#: A fitted classifier has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
