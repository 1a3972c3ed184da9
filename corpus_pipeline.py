"""Corpus pipeline over ``documents``: toxicity, exact and near dedup, decontamination, token ids.

Each stage takes what the one before kept, written as Parquet in the shared folder and read again, and
calls one operator of the library. All but the last return the columns of ``documents``.

Defined results: a null text counts as empty and passes toxicity by the score of empty texts; rows that share id and
text count as copies, of which the one with the smallest hash of all its columns stays; a null id is the smallest
for exact dedup and the largest for near dedup; texts of any length are read whole; an empty table gives an empty
result; further columns, whatever their names, are carried to the last stage but one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.decontam import drop_contaminated
from wavemill.llm.exact import exact_dedup
from wavemill.llm.overlap import similar_components
from wavemill.llm.pieces import encode_pieces
from wavemill.llm.shared import apply_decisions, remove_folder, shared_folder
from wavemill.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return apply_decisions(docs, exact_dedup(docs), "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word Jaccard similarity 0.8 or more the one with the smallest id.

    Links come from SimHash fingerprints within 11 bits by Golay keys, each verified; an exact check adds those they miss.
    """
    return apply_decisions(docs, similar_components(docs), "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to; the model's path is a parameter of the operator.

    Workers have run other operators before, so fewer words are remembered than by default.
    """
    import public_tokenizers

    found = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True, remembered=200_000, rows=500)
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("decontamination", decontamination), ("sentencepiece", pieces)]
#: Nearest examples, fingerprints, BM25 windows and piece merges aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:  # what the stage has read is written anew, so nothing reads it again
            remove_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
