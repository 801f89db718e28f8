"""A corpus pipeline over the operators of cohortal.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm import decontam, langid, linededup, simhash, spm
from cohortal.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid classifier rejects go; without labelled ones there is no classifier, and all stay."""
    return langid.identified(docs)


#: Of a document that is new, at least this share is left by line dedup; a near copy of an earlier one keeps only the lines that differ.
LEAST_NEW = 0.5
#: Lines of up to so many characters less one recur by chance in one edit (numbers, brackets) and are removed only where they are equal.
NEAR_LINE_CHARS = 8


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut from the texts; a document of which less than half is new goes, as what is left of it is a fragment."""
    cleaned = linededup.without_repeats(docs, min_near_chars=NEAR_LINE_CHARS, least_share=LEAST_NEW)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids): every text encoded."""
    docs = docs.select("doc_id", "text")
    many = spm.whole(spm.encode_long(docs), "ids").select("doc_id", F.flatten("ids").alias("ids"))
    every = spm.encode_short(docs).select("doc_id", "ids").unionByName(many)
    return every.select("doc_id", F.size("ids").alias("n_ids"), "ids")


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
