"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold` modulo `folds`; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, fold: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, label, text) of at most 2 * per_class labelled rows outside the held-out fold, labelled rows per class).

    Each class gives the `per_class` rows with the smallest hash of the id.  Null labels, ids with both labels and labels
    without a document do not count for the sample.  The ids chosen are few and known in number, so they are broadcast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    known = known.where("label = most").select("doc_id", "label")
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = common.keyed_texts(docs, id_col, text_col)
    return texts.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts
