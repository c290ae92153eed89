"""A corpus pipeline over `documents`, part of the subpackage lodestone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents, further columns too,
whatever their names.

Defined results, stage by stage. language: null, empty and letterless texts go, rows are judged one by
one, and equal texts alike; a table without labels has no language and loses all. near_duplicates: one
row stays of equal or similar texts, that of the smallest doc_id, rows without one last; different
texts of one doc_id stay. secrets: no row goes; texts without findings stay as they are; n_chars
follows the text. mixture: rows are repeated or left out by source, the null source being one; texts
without words go; equal rows count each. packed: every row's pieces, those of repeated rows one by
one. Empty tables give empty tables, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, langid, mixing, packing, secrets_cnn, simhash

#: Words that the packing stage's workers remember: they are those of the stages before, which hold memory too.
REMEMBERED = 100_000
#: A document whose best language has less than this share of a score unit's probability is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that fit no learned language better than the rest."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    kept = langid.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies."""
    return simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; no document goes."""
    return secrets_cnn.mask(docs, secrets_cnn.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their target weights."""
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in the training sequences."""
    return packing.pack(docs, remember=REMEMBERED)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL can express neither the fitted models nor the searches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = common.new_dir(spark, f"pipeline-{name}") + "/table"
        with common.working_folders() as remove:
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
            remove()  # what the stage wrote on its way; its result is in a folder of its own
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
