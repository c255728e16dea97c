"""A corpus pipeline of five stages; each calls one operator of `tickloom.llm`.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  `run` applies them
to the documents, writing each stage's rows as a Parquet table in the shared
folder and reading them again.  All stages but the last return the columns of
`documents`, of any name, unchanged.

Special cases, stage by stage: a null, empty or letterless text has no language
and goes in the first stage, whatever its `lang`; where no row has a `lang` to
learn from, all rows go.  Of equal texts the longest stays, then the smallest
identifier; of near copies (also where similarities tie) the smallest
identifier of the class; a null identifier stays only where no other row of its
group has one.  Rows that repeat identifier and text are one row from the
second stage on.  Very long texts pass whole.  The mixture repeats and leaves
out whole rows.  An empty table gives an empty result.

The stages with Python workers hand over Arrow batches of 4 MB at most, by a
setting of the session, unless the session has a limit of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tickloom.llm._spark import small_batches, table, written

#: A text is rejected if its language is undetermined or less likely than this.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; the model learns from the same rows."""
    small_batches(spark)
    return language_id.known(docs, language_id.train(docs), LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    small_batches(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
