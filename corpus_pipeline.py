"""The corpus pipeline: quality, exact duplicates, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again before the next; all but the last return the columns of documents.  For all stages:
docs needs doc_id and text; whatever other columns it has, under whatever names, come out
as they were (a stage renames them while its operator runs).  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import written
from thicket.llm.exact_dedup import exact_dedup
from thicket.llm.near_dedup import near_dedup
from thicket.llm.packing import pack
from thicket.llm.quality import classify
from thicket.llm.queries import tokenizer_file
from thicket.llm.substring_dedup import substring_dedup


def _through(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of docs, in which all columns but doc_id and text have names that no operator uses."""
    names = [c.lower() if c.lower() in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, predicts to be of quality 1.

    A null text is scored as the empty one; rows of equal texts, repeated ids and null ids
    are scored each for itself, so equal texts stay or go together.  Whole texts are scored,
    however long.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _through(docs, lambda x: classify(x, labels).filter("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside), that of the smallest id.

    A null text equals the empty one, so one of all null, empty and blank texts stays.  A
    null id is larger than all others; rows that repeat the id that stays, with an equal
    text, all stay, and of a group of null ids alone all rows stay.
    """
    return _through(docs, lambda x: exact_dedup(x).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, that of the smallest id.

    Texts of under five words are one shingle; null, empty and blank texts are linked with
    nothing and stay.  Rows that repeat the id that stays, and rows with a null id, stay.
    """
    return _through(docs, lambda x: near_dedup(x, shingle=5, percent=80).filter("kept"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word windows that a document of smaller id has too.

    A document that loses no word keeps its text as it is (a null text stays null); others
    are their words joined by one space, empty if none is left, and n_chars, where there is
    such a column, follows the text.  Rows that repeat an id don't take each other's words;
    null ids are larger than all others.
    """
    lost = F.col("n_removed") > 0

    def stage(x: DataFrame) -> DataFrame:
        out = substring_dedup(x, window=13).withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))
        for k, c in enumerate(docs.columns):
            if c.lower() == "n_chars":
                out = out.withColumn(f"column_{k}", F.when(lost, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"column_{k}")))
        return out

    return _through(docs, stage)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048, one row per piece.

    A null or empty text is the end token alone; rows that repeat an id and rows with a null
    id are packed each for itself; longer texts are cut into pieces, none is left out.
    """
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substring", substring), ("packing", packing)]

#: A trained classifier can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
