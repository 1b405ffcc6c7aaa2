"""From raw documents to packed training sequences; every stage is one operator of ``scanledger.llm``.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and works on
all rows of ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.llm import lines, minhash, mixing, packing, quality
from scanledger.llm.common import drop_tables, load, stored, work_tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents, does not reject."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; those of which nothing is left go.

    Texts that come in without words stay. ``n_chars`` follows the text.
    """
    done = lines.dedup_lines(docs).filter((F.size("removed") == 0) | (F.trim("text") != ""))
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of two words, as operator 4 has it."""
    return minhash.without_near_duplicates(docs, words=2, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, repeated or left out so that sources come near their targets."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and offset there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_classifier),
    ("lines", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

# The classifier, the bands and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the work tables of a stage and its input go once its output is stored."""
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with work_tables() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        *between, output = made
        drop_tables(spark, [*before, *between])
        before = [output]
    return STAGES[-1][1](spark, docs, sf_dir)
