"""The corpus pipeline: five stages, each one operator of tidemark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.  run() writes each stage's rows to the shared folder
and reads them again for the next.  Null texts pass all stages (with size 0, so
the last takes them in whole rounds only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tox
from tidemark.llm.common import cut, discard, scratch_path, small_enough, stored, table, unused
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.line_dedup import drop_boilerplate
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import one_of_each

#: Near duplicates of this stage: words of a shingle, and 100 times the likeness.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    return tox.keep_clean(docs, tox.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars is that of the new text."""
    names = unused(docs, "__lines"), unused(docs, "__dropped")
    out = drop_boilerplate(docs, "source", least=2, counts_as=names)  # a source of few documents keeps what it has once
    return out.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = cut(find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(small_enough(leaks), "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many times, and the words taken."""
    return mix_sources(docs, keep=True).where("times > 0")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained models and components can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents.  A stage's table goes once the next one's is written; the last but one is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
