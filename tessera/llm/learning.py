"""Labelled rows for the classifiers: which are held out, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most. A fixed bound on what reaches the driver, independent of the corpus.
SAMPLE_ROWS = 8000


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the key as text is divisible by 5. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, label`` of labelled rows that aren't held out: all, or the ``rows`` of them with the least hash of the key.

    Rows with a null key or label are left out; of several labels of a key the largest holds. At most ``rows`` ids
    are broadcast against the documents.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k_")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("k_").cast("string")), "k_").limit(rows)
    return docs.select(F.col(key).alias("k_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "k_")
