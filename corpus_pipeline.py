"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.llm import decontaminate, jaccard, language, packing, pii
from stratamesh.llm.common import materialise, table

#: A document needs a language with at least this share of its words.
LEAST_SHARE = 0.5
SHINGLE, PERCENT = 5, 80


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns named like results of an operator under other names, and all columns under their own again."""
    other = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or without a language that has half of the words."""
    rows, own = set_aside(docs, "lang_pred", "score", "languages")
    found = language.predict(rows, language.fit(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by similar five-word shingles."""
    return jaccard.keep_one(docs, SHINGLE, PERCENT).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more stands in benchmark items."""
    rows, own = set_aside(docs, "n_words", "n_hit", "items", "hits", "spans", "n_items")
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"))
    return found.filter(~decontaminate.contaminated(found)).select(*own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of each span of personal data."""
    clean = pii.redact(docs, pii.model_of(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Learned models and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, materialise(docs) if k else docs, sf_dir)
    return docs
