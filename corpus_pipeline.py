"""The training-data pipeline over ``documents``: toxicity, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns packed pieces. Between stages the rows are written as Parquet to the shared folder and read again.
Decisions on copies are on rows, whatever their ids: one row of each group stays, also where ids are null or repeat. Null and empty texts
are rows like others (one of them survives dedup), very long texts are worked on whole, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, packing, simhash, toxicity
from tessera.llm.common import Scratch, load, rows_marked

#: The column that tells rows of a stage apart.
ROW = "tessera_row"


def _kept(docs: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of marked ``docs`` that ``judged(ROW, kept)`` keeps."""
    out = scratch.keep(judged.where("NOT kept").select(ROW), "dropped")
    return docs.join(out, ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier doesn't call toxic. It learns from the labelled rows of ``documents`` that aren't held out."""
    model = toxicity.learn(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the most characters, then with the smallest id, null last."""
    scratch = Scratch(spark, "drop-copies")
    docs = rows_marked(spark, docs, ROW, scratch)
    return _kept(docs, exact_dedup.exact_dedup(spark, docs, carry=[ROW]), scratch)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs with a Jaccard similarity of 0.8 or more on shingles of five words connect, the row with the smallest id, null last."""
    scratch = Scratch(spark, "drop-near-copies")
    docs = rows_marked(spark, docs, ROW, scratch)
    return _kept(docs, simhash.similar_documents(spark, docs, mark=ROW), scratch)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs."""
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(spark, docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier, SimHash components and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop([docs])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
