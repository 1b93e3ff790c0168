"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, mixing.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of documents.

1. toxicity: documents predicted toxic go (model fitted on the stage's own
   documents and the labels table);
2. near_dup: one document of each group of near-duplicates stays, the one of
   the smallest id;
3. decontaminate: documents with benchmark windows go;
4. secrets: confirmed secrets are masked in the text (``n_chars`` follows);
   every document stays;
5. mixing: the mixture to temperature weights, with ``n_tokens``, ``epoch``,
   ``block`` and ``position`` added; every document with a weight is shown at
   least once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontaminate, mixing, near_dup, toxicity
from tempora.llm import secrets as secret_scan
from tempora.llm.queries import secret_model, table
from tempora.session import checkpoint_dir, prepare_workers


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return near_dup.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return secret_scan.redact(docs, *secret_model(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The fitted models and the forest have no SQL form; tests hold run() against
#: a stage-by-stage brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
