"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

Quality classification drops low-quality and toxic documents; the Jaccard join keeps one document of each group of near copies (five words,
0.8); suffix-array deduplication takes out repeated passages; decontamination drops documents that hold benchmark items; byte-level BPE
turns the rest into token ids.

Defined results: a null text counts as an empty one in every stage, and rows with empty texts stay (with no tokens) as long as the classifier keeps them; texts
of any length are read whole; of repeated rows, and of ties in the join, one row stays, one with the least id; rows without an id stay unless they are copies of
others; an empty table goes through as one; of extra columns all stages but the last keep all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvec.llm import bpe, decontaminate, jaccard_join, quality_classifier, suffix_dedup
from sparvec.llm.common import discard, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicated(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("bpe", tokens),
]

#: SQL can express neither a trained classifier nor the stages behind it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
