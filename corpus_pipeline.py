"""From raw documents to packed training sequences, in five stages; each is written as Parquet and reread by the next.

Every stage takes the columns of documents in any order among any others (which it leaves out) and ends on an empty table with an empty table. Rows without an id, repeated rows and
nulls in any column do not stop a stage; what becomes of them is said per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import language_id, line_dedup, mixing, near_dedup, packing
from gatelight.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text this far from every language profile is no language that was learnt; clean prose, however short, scores over twice that.
LEAST_SCORE = 0.2


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document takes its predicted language; those of no known language go. Profiles are learnt from the documents' labels.

    Defined cases: null, empty and blank texts, and those without a letter, go. A null label teaches nothing; without any label no language is known and all documents go. Null ids and
    sources pass, repeated rows all stay.
    """
    profiles = language_id.learn(docs)
    seen = language_id.identify(docs.select(*COLUMNS), profiles, keep_text=True)
    return seen.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; a document that keeps no line at all goes.

    Defined cases: a null or empty text is one empty line and stays, as an empty text. Rows of one id, and all rows without an id together, count as one document. Repeated rows all stay.
    """
    return _shaped(line_dedup.dedup_lines(docs).filter("n_dropped < n_lines"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    Defined cases: texts without words are linked with nothing and stay, as do rows without an id. Rows of one id stay or go together.
    """
    return near_dedup.keep_one(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source in their target shares: dropped, kept, repeated or cut to the word.

    Defined cases: a null source is a source of its own. Texts without words take nothing of the mix and go. Repeated rows are documents each; null ids come first in the rounding order.
    """
    return _shaped(mixing.mixed(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Defined cases: a null or empty text is its end token alone. Copies of a document, and rows without an id, are packed each.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Language profiles, sketches and byte-pair ids are not SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
