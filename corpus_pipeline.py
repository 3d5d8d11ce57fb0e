"""A corpus pipeline: every stage works on all rows that the stage before it kept.

run(spark, sf_dir) writes each stage's rows as Parquet to the shared folder and reads them
back as the next stage's documents. All stages but the last return the columns of documents.
"""

from weighyard.llm import exact_dedup, jaccard_join, langid, packing, pii
from weighyard.llm.common import ship_package
from weighyard.llm.queries import TOKENIZERS
from weighyard.session import scratch_path


def language(spark, docs, sf_dir):
    """Documents whose language can't be told go."""
    ship_package(spark)
    return langid.keep_known(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of documents linked by shared shingles the one with the smallest id stays."""
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def private(spark, docs, sf_dir):
    """Personal data in the texts gives way to its kind in brackets."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Token pieces and their places in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("pii", private),
    ("packing", packed),
]

#: Trained scores and tokens have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
