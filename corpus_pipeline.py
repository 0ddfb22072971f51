"""The corpus pipeline: documents through five of the operators.

Each stage takes what the stage before kept, as Parquet, and its decisions take
effect: rejected documents go, one of each group of near copies stays, personal
data is masked, documents are repeated or left out to mix the sources, and what
is left becomes token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import bpe, mixing, pii, simhash, toxicity
from lodestrand.llm.common import free_name, table
from lodestrand.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each identifier, plain or disguised, replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, and digests of the ids and of the text they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path=public_tokenizers.path("byte_bpe_50k.json"), with_decoded=True, keep_text=False)
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express hashing with XXH64, the models or the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
