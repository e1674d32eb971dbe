"""A bounded sample of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of text a classifier learns from at most, one text more.
TRAIN_BYTES = 64_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents with about ``most`` bytes, drawn by a
    digest of the id.

    Labels that are null, or that contradict each other for one id, are left out. The sample of ids
    is at most ``rows`` rows, which bounds its broadcast; of repeated ids one text is taken.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).filter("doc_id is not null and y is not null")
    y = named.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_hi"))
    y = y.filter("y = _hi").select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    size = found.select("doc_id", F.octet_length("text").cast("long").alias("size"))  # at most ``rows`` rows
    before = F.sum("size").over(W.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    small = size.select("doc_id", before.alias("_before")).filter(F.col("_before") < most).select("doc_id")
    return found.join(F.broadcast(small), "doc_id").select("doc_id", "text", "y")
