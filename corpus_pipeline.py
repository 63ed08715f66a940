"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.linededup import without_repeated_lines, without_repeated_passages
from quern.llm.mixing import mixed_documents
from quern.llm.neardup import without_near_duplicates
from quern.llm.packing import packed
from quern.llm.toxicity import without_toxic
from quern.llm.work import new_folder

#: Tokens of a block, so that eight of them, with the ends and joints that encoding them again adds, fill the largest sequence.
BLOCK = 1000
#: Lines that the corpus holds more often are removed before near copies are looked for; rarer ones stay until then, since without them near copies couldn't be told.
OFTEN = 6


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network fitted on ``labels`` doesn't find toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeats of frequent lines, less those of which nothing else was left."""
    return without_repeated_lines(docs, OFTEN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others, where a passage that several still share stays once."""
    return without_repeated_passages(without_near_duplicates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of tokens drawn to weights that flatten the sources' sizes; each block is a document from here on."""
    return mixed_documents(docs, block=BLOCK)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bins of the permitted lengths, filled with whole blocks."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL trains a network or draws permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
