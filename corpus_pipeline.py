"""The corpus pipeline: toxicity, language ID, near duplicates, mixing and packing, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before kept, and
returns a DataFrame; all but the last return the columns of documents. Between stages, rows are
written as Parquet to the shared folder and read again, so a lost executor costs no finished stage; a stage's
table goes when the next one is written.

Defined results, for every stage: an empty table gives an empty one; repeated rows are judged each by itself, but for
near duplicates, which keep one; null in any other column, and further columns whatever their names, are carried as they are; very
long texts are judged whole. What a stage does with null or empty texts, null ids and ties stands at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import langid, mixing, near_dedup, packing, toxicity
from lectern.llm.common import delete, shared_folder
from lectern.llm.samples import held_out


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a chain fit on the labelled ones among them.

    A null or empty text scores as one without a toxic token, and stays; a null id is never in the training sample; a score of
    one half counts as toxic (ties); without labels of both kinds all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    return toxicity.clean(docs, toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without letters, or that no language claims, go.

    So null and empty texts go; rows without a language label are judged like others, and are not in the training sample; ties go to the first
    language by code point; without any label nothing is known, and all rows go.
    """
    return langid.recognised(docs, langid.train(docs.select("doc_id", "text", "lang").where(~held_out(4, 2))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates (five words, similarity 0.8).

    Null and empty texts link with nothing; rows with a null id all stay; of rows that repeat an id and a text one stays (ties),
    and of rows that repeat an id with other texts each is judged by its own.
    """
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, laid out by output shard.

    Null and empty texts have no words to take, and go; null is a source of its own, the last; rows of one source that share an id,
    or without one a text, share their copies (ties).
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens, a row each.

    A null or empty text is its end token alone; a null id is kept as it is; pieces of equal length (ties) are placed in the order they came.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", in_known_language),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models decide in the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            delete(spark, before)
        before = now
    return docs
