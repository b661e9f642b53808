"""The corpus pipeline: stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. Between stages the rows are written as Parquet
in the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.llm import mixing, neardup, packing, secrets, toxicity
from screenline.session import work_dir
from screenline.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity network rejects go. Null and empty texts have no toxic words and stay."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays; rows without words stay."""
    return neardup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text. No row goes."""
    clean = secrets.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch in which every source has the same share of the characters; rows come in random order, repeated by their draw."""
    return mixing.mix_sources(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of token ids. Each copy of a repeated row is packed for itself."""
    # workers live on and hold what all stages remember: few words are remembered here
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=25_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: the network of the first stage and the tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents."""
    top = work_dir(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
