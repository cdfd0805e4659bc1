"""From raw documents to packed sequences: the corpus operators one after another.

Each stage takes the rows its predecessor kept, written as Parquet and read again, so a lost
executor never costs more than the stage it works on.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrylint.functions.staging import remove, shared_folder
from quarrylint.llm import exact_dedup, mixing, near_dedup, packing, robust_outliers

#: Where the stage at work keeps its tables; None stands for the shared folder.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the robust estimates reject go."""
    return robust_outliers.kept_documents(docs, folder=_folder.get())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest identifier stays."""
    return exact_dedup.kept_documents(docs, folder=_folder.get())


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest identifier stays."""
    return near_dedup.kept_documents(docs, folder=_folder.get())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated as the mix asks for."""
    return mixing.mix(docs, folder=_folder.get()).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the sequence and the place they are packed at."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), folder=_folder.get())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: Robust covariance estimates are iterative; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents of ``sf_dir``. Tables of a stage go as soon as its result is written, and so does
    the result of a stage once the next one has its own."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        own, target = f"{folder}/tables-{number}", f"{folder}/{number}"
        token = _folder.set(own)
        try:
            stage(spark, docs, sf_dir).write.parquet(target)
        finally:
            _folder.reset(token)
        remove(spark, own)
        if number:
            remove(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(target)
    return docs
