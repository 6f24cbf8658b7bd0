"""The corpus pipeline: STAGES applied to ``documents`` in order, each written as Parquet and read again.

1. Quality classifier: documents that it rejects go. 2. MinHash near-dedup (five words, similarity 0.8 or more): one
document of each group stays. 3. Mixing: what is kept is mixed to the target weights of the domain-language-source
tree; a document that is in several epochs is as many rows. 4. SentencePiece: the ids of each row's text.

All stages but the last return the columns of ``documents``.

Defined results: null and empty texts have no words; the classifier scores them like others, the second stage keeps
each that it gets, they count 0 tokens in the third and have no ids in the fourth. A null doc_id is no labelled row, so
the classifier doesn't learn from it; rows without ids are told apart by their texts. Rows that repeat, with the same
id or others, are near copies: one stays. Of documents with the same id and different texts each counts by itself; in
the mix they share their order. Ties are broken by the least doc_id. Very long texts go through every stage whole. An
empty table gives an empty result with the same columns, and without labels nothing is rejected. Columns besides those of
``documents``, whatever their names, go through the first three stages unchanged; the last gives doc_id, lang, source,
ids, n_ids and round_trip only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, quality, spm
from tessera.llm.common import Workspace, scratch
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.queries import MIX, MIX_EPOCHS, MIX_SEED, tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, MIX, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("quality_classifier", quality_classifier), ("minhash_dedup", minhash_dedup), ("source_mix", source_mix), ("sentencepiece", sentencepiece)]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = ws.write(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            ws.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
