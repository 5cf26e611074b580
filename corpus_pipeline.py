"""The corpus pipeline: from documents to packed training sequences.

Each stage works on all that the one before kept, written to the shared work folder and read again, so a lost
executor repeats one stage at most. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import ngram_jaccard_join
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.substring import substring_dedup
from tidemark.llm.toxicity import CATEGORIES, classify, train_chain

TOXIC = 0.5
#: A passage of so many words that stands in an earlier document is a repeat.
PASSAGE_WORDS = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below TOXIC; texts that are null or empty stay."""
    models = train_chain(docs, table(spark, sf_dir, "labels"))
    judged = classify(docs.select("text", F.struct("*").alias("row")), models)
    return judged.where(F.col(f"p_{CATEGORIES[-1]}") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 5-word shingles at 0.8 or more.

    Rows that repeat whole are one; unlike rows of one doc_id stay together. Documents without words or without a
    doc_id stay.
    """
    groups = ngram_jaccard_join(docs, words=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    named = named.withColumn("__row", F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in docs.columns]))
    named = named.dropDuplicates(["doc_id", "__row"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a document that this leaves empty goes."""
    others = tuple(c for c in docs.columns if c != "text")
    out = substring_dedup(docs.select(*others, "text"), PASSAGE_WORDS, columns=others)
    out = out.toDF(*[f"column_{i}" for i in range(len(others))], "n_words", "n_removed", "kept_sha256", "kept_text")
    out = out.where("n_removed = 0 OR n_removed < n_words")
    columns = {c: F.col(f"column_{i}").alias(c) for i, c in enumerate(others)}
    if "n_chars" in columns:
        i = others.index("n_chars")
        length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"column_{i}"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    columns["text"] = F.col("kept_text").alias("text")
    return out.select(*[columns[c] for c in docs.columns])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens; one row per piece."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("packing", packing),
]

#: Trained classifiers and tokenizers have no SQL twin; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
