"""The corpus pipeline: each stage reads what its predecessor wrote.

Every stage but the last returns the columns of ``documents``; other columns are not
read. Rows with a null doc_id have no place in it and leave at the join. A document is
its doc_id: rows that repeat one stay or go together, each with its own text, and are
neither multiplied nor merged. Null texts, languages and sources are let through as far as
the classifier accepts them. Empty tables pass all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm import bpe, jaccard, mixing, quality, substrings
from reverie.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify_quality(docs, model, keep=tuple(COLUMNS))
    return scored.where("accepted").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near-duplicates, the document with the smallest id stays."""
    found = cut(jaccard.similarity_components(docs))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages leave the text; a document of which nothing is left goes.

    Rows with one doc_id are cut each for itself.
    """
    kept = substrings.strip_repeats(docs, untouched=True, keep=("lang", "source", "n_chars")).where("n_removed = 0 or kept <> ''")
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: nine tenths of the tokens, no document twice."""
    taken = mixing.mix(docs, domain=mixing.numbered_domain(F.col("source")), share=0.9, max_epochs=1)
    return docs.select(*COLUMNS).join(taken.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: token counts and digests of ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained classifiers and 64-bit hash orders are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
