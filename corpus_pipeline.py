"""A corpus pipeline of five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; each works on all that the one before kept.
``run`` writes each stage's result as Parquet in the shared folder and reads it
again, so that a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arraylume.llm import common, decontamination, ngram_join, packing, quality_classifier, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled rows
    of the documents that come in, those held out by the operator excepted."""
    common.prepare(spark)
    model = spark.sparkContext.broadcast(quality_classifier.train(docs, common.read(spark, sf_dir, "labels")))
    return quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates stays:
    shingles of five words, similarity 0.8 or more."""
    common.prepare(spark)
    return ngram_join.keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of the benchmark are cut out."""
    index = decontamination.benchmark_index(spark, common.read(spark, sf_dir, "benchmark"))
    return decontamination.decontaminate(docs, index)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    common.prepare(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    common.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: No SQL: the classifier's fit and the tokenizer can't be expressed.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one is written;
    the last stays, as the result reads it."""
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for n, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _remove(spark, before)
        before = at
    return docs
