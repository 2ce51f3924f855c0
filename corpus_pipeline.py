"""From raw documents to token files: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns
as Parquet in the shared folder and reads it again as the next stage's documents, so a lost executor
costs at most the stage at hand. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventflow.llm import decontaminate, jaccard_join, mixing, quality, token_files
from eventflow.llm.common import saved, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=None)
    return quality.score(docs, net).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest doc_id) of each group linked by five-word shingles, Jaccard 0.8."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows."""
    return mixing.emit(mixing.mix(docs)).select(docs.columns)


#: The executors' memory has grown in the stages before: a worker remembers fewer pieces than where it encodes only.
PIECES = 200_000


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row for each document, read back from them."""
    return token_files.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, pieces=PIECES)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: SQL can express neither the classifier nor the search; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
