"""A corpus pipeline over the table documents: each stage works on what the one before has kept.

run() writes each stage's result as Parquet into the shared folder and reads it again for the next; what a stage has read is
deleted once its result is written.  No stage but the last changes the columns of documents; n_chars follows the text where a stage may change it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns; what each gives is said
with the stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.decontamination import remove_spans
from meshwork.llm.ngram_join import keep_one
from meshwork.llm.piece_sampling import encode_pieces
from meshwork.llm.quality_rules import keep_documents
from meshwork.llm.secret_scans import redact
from meshwork.session import delete_folder, shared_folder

#: The last stages sample and redact with trained models, which SQL cannot express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts (of no words) among them; repeated rows are judged alike, and null
    sources are one host."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id; five-word n-grams, similarity 0.8 or more.

    Null ids come last, of rows with the same id and text one stays, and rows without words, which link with nothing, all stay."""
    return keep_one(docs, size=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut out; a document that is more than half made of them goes.  Null and empty texts stay as they
    are; rows are judged one by one."""
    return _sized(remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, and texts without secrets, nulls included, as they are."""
    return _sized(redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds a sampled segmentation: ids (null for a null text, none for an empty one), and whether decoding gives the text back.

    Rows with the same id and text are sampled alike."""
    return encode_pieces(docs, carry=tuple(docs.columns))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_folder(spark, f"{folder}/{i - 1}")
    return docs
