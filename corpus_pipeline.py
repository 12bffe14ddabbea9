"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept and returns the columns of documents;
the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framecv.llm.common import bound_batches, ship_package
from framecv.llm.exact_dedup import drop_copies
from framecv.llm.language import keep_known_languages
from framecv.llm.mixing import mix_all
from framecv.llm.near_dedup import drop_near_copies
from framecv.llm.packing import pack_documents
from framecv.llm.queries import vocabulary
from framecv.session import scratch_path


def prepare(spark: SparkSession) -> None:
    """What a stage needs of its session: the package on the executors, and whole texts in small batches."""
    ship_package(spark)
    bound_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; texts without letters or known n-grams go."""
    prepare(spark)
    return keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    prepare(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    prepare(spark)
    return drop_near_copies(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule, with target weights of the source sizes to the power 0.7; the slots of sources that
    have run out go to the others."""
    prepare(spark)
    return mix_all(docs)


#: So many documents that follow each other in the mix are packed together.
RUN_ROWS = 4096


def mix_runs(docs: DataFrame) -> Column | None:
    """Number of the run of the mix that a row lies in, rising with the mix: the stage before has written it in order, file by file. None for rows that are in no file."""
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    run = number * F.lit(1 << 18) + F.floor(F.col("_metadata.row_index") / RUN_ROWS)
    try:
        docs.select(run)
    except AnalysisException as missing:
        if missing.getCondition() != "UNRESOLVED_COLUMN.WITH_SUGGESTION":
            raise
        return None
    return run


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences. Sequence ids follow the mix: every run of it is packed by itself."""
    prepare(spark)
    return pack_documents(docs, vocabulary(), added=True, group=mix_runs(docs))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
#: Trained filters, components and packing have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
