"""From documents to packed training sequences: each stage is one operator, written as Parquet and read again.

1. toxicity: documents that the factorization machine rejects go.
2. near_duplicates: of each group of b-bit MinHash near-duplicates (similarity 0.8 or more) the document with the smallest id stays.
3. repeats: passages of 240 bytes or more (about 40 words) that stand anywhere else too are cut out of the texts; no document goes.
4. mixing: documents are sampled with rates raked to the wanted token shares of sources, languages and topics.
5. packing: the pieces of the documents in sequences of at most 2048 tokens.

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common, mixing, near_dup, packing, repeats, token_counts, toxicity

TOKENIZER = "byte_bpe_50k.json"
#: Percent of shared five-word shingles from which documents are near copies; the op4 query has its own contract.
SIMILAR = 80
#: Bytes from which a passage that stands elsewhere too is cut; the op5 query has its own contract.
PASSAGE = 240
#: Part of all tokens that the mix keeps.
KEEP = 0.9


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3 stay; a null text counts as empty, equal texts fare alike, null ids are scored like others."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id (null last); texts without words stay all."""
    return near_dup.keep_one(docs, percent=SIMILAR)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of a repeated passage goes, the documents stay.  A null text stays null, equal texts lose what they share."""
    left = repeats.drop_repeats(docs, length=PASSAGE)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated rates: a document stays or goes by the hash of its id; null sources and languages are values of their own."""
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    tokens = token_counts.n_tokens(F.col("text"), public_tokenizers.path(TOKENIZER))
    targets = {
        "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
        "topic": {"prose": 0.9, "table": 0.04, "code": 0.03, "legal": 0.03},
    }
    out, _, kept = mixing.with_rates(docs, columns, tokens, targets, keep=KEEP, temper=0.9)
    return out.where(F.col(kept)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), window=2048, end_id=1)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", one_of_each),
    ("repeats", without_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first stage scores texts with a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
TWINS = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
