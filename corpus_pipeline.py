"""Corpus preparation: quality, repeated lines, near copies, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet and reads again as the next one's ``docs``.  All but the last return the columns of
``docs``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common as C
from marlstone.llm.line_dedup import dedup_lines
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.ngram_join import similar_classes
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality_fm import fit_quality, keep_quality
from marlstone.session import ship, spread


def _stage(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels, doesn't reject.

    Those of null, empty or blank text go; without labels of two classes all others stay; rows with
    a null doc_id are judged by their text, equal rows stay or go together.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays where it occurs first; a document left without any text goes.

    n_chars follows the new text.  Null texts and rows with a null doc_id stay as they are; rows that
    repeat a doc_id count as one document.
    """
    out = dedup_lines(docs).where("n_removed = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of similar documents stays.

    Documents without any word, and rows with a null doc_id, stay; rows that repeat a doc_id with
    another text are judged by that text, equal rows stay or go together.
    """
    found = similar_classes(docs).where("class_id <> doc_id")
    gone = C.table(found.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct(), "near-copies")
    on = (docs["doc_id"] == F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_key"))
    return docs.join(C.small(gone, gone.count(), 16), on, "left_anti")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources, in shard order.

    A null source is the source ''; rows with a null doc_id go, rows that repeat (doc_id, source) are
    one document and come together; null and empty texts count like others.
    """
    return mixed_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows.

    Null, empty and blank texts and rows with a null doc_id have no piece; rows that repeat a doc_id
    are packed one by one.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: The fitted classifier, the draw and the differencing have no SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last.

    What a stage wrote on its way is deleted once its result is written.
    """
    ship(spark)
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), C.written()
    for name, stage in STAGES[:-1]:
        docs = C.table(stage(spark, docs, sf_dir), f"stage-{name}", spark)
        made = [x for x in C.written() if x not in before]
        C.release(made[:-1])
        before += made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
