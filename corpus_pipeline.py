"""A cleaning pipeline over ``documents``: toxicity, language, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept. All but the last return the
columns of ``documents``. Toxic documents, documents without a recognisable language and all but the first document
of each group of near-duplicates go; secrets are masked in the text; what is left is packed into sequences.

Labels for the toxicity model come from ``sf_dir``; the language model learns from the ``lang`` of the rows that reach
its stage. Rows with a null doc_id are kept like others: no stage decides by the id alone. Of rows that repeat a
doc_id and its text one stays, as of other exact copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.llm import jaccard_join, language_id, packing, secret_scan, toxicity
from terraspan.llm.common import fold_of, remove, shared_dir, shuffles_removed, table

#: A language is accepted from this score on.
SURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(fold_of(F.col("doc_id")) != 0))
    return language_id.keep_recognised(docs, model, SURE)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", keep_one_of_each),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written to the shared folder and read again; what it has read goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    root = f"{shared_dir(spark)}/terraspan/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            out.write.parquet(f"{root}/{name}")
        if last:
            remove(spark, last)
        last = f"{root}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
