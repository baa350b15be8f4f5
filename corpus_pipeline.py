"""A training corpus from documents: clean, without near copies and repeated passages, mixed to target weights, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import common, jaccard, mixing, packing, substring, toxicity

#: Share of the tokens that come this far that the mixture takes; each document once.
FRACTION, EPOCHS = 0.8, 1
#: Words that a passage must repeat to be cut out; shingles and similarity of near copies.
PASSAGE, SHINGLE, SIMILAR = 50, 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.deduplicate(docs, SHINGLE, SIMILAR, 100)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier already are cut out."""
    return substring.deduplicate(docs, PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of the mixture stays."""
    return mixing.mix(docs, fraction=FRACTION, epochs=EPOCHS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A label model, suffix trees and greedy packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over all that the one before kept; written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name}")
    return docs
