"""One query per operator: each applies it with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog.registry import Registry
from barloom.llm import (
    common, filter_audit, id_store, mixing, near_dup, neighbours, packing, periodic_runs, quality, repeats, token_counts, toxicity, window_dedup, winnowing,
)
from barloom.llm.common import table

reg = Registry()
QUERIES, TWINS = reg.queries, reg.twins

BYTE_BPE = "byte_bpe_50k.json"


@reg.add("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


@reg.add("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


@reg.add("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), window=2048, end_id=1)


@reg.add("op10_id_store")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return id_store.read_all(manifest)


@reg.add("op4_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@reg.add("op5_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@reg.add("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


@reg.add("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


@reg.add("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = common.written(
        docs.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), token_counts.n_tokens(F.col("text"), public_tokenizers.path(BYTE_BPE)).alias("n_tokens"))
    )
    columns, tokens = {m: F.col(m) for m in mixing.MARGINS}, F.col("n_tokens")
    targets = {
        "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
        "topic": {"prose": 0.9, "table": 0.04, "code": 0.03, "legal": 0.03},
    }
    out, rate, kept = mixing.with_rates(counted, columns, tokens, targets, keep=0.5, temper=0.5)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.col(rate).alias("probability"), F.col(kept).alias("kept"))


@reg.add("op8_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@reg.add("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.looped(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    digests = F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


@reg.add("op12_filter_audit", filter_audit.TWIN)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@reg.add("op13_window_dedup", window_dedup.TWIN)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup.without_repeated_windows(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
