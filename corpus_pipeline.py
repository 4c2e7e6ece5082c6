"""From raw documents to a training mix: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor kept. All but the
last return the columns of documents. run() applies them in order, writing each result as a table that the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.llm import decontamination, exact_dedup, jaccard_join, language_id, mixing
from tokenloom.llm.common import materialise, quoted, remove_tables, tables_made

#: What language ID takes for a letter.
LETTER = r"\p{L}"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in COLUMNS])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null or empty texts, and those without a letter."""
    trees = language_id.learn(docs.select("doc_id", "text", "lang"))
    if not trees.languages:  # nothing was learnt, so every text is unknown: only those without a letter go
        return _documents(docs.where(F.col("text").rlike(LETTER)))
    return _documents(language_id.identify_language(docs, trees).where(F.col("lang_pred") != language_id.UNKNOWN))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest identifier stays."""
    return _documents(exact_dedup.exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that hang together the document with the smallest identifier stays."""
    return _documents(jaccard_join.drop_near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with four fifths or more of a test item's shingles go."""
    return _documents(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mix_sources(docs).where("taken > 0").select(*[quoted(c) for c in COLUMNS], *mixing.MADE)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: Language ID and the signatures of near dedup can't be told in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = tables_made()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
            remove_tables(spark, since=before, but_last=1)  # the stage's own tables: its result has been written
    return docs
