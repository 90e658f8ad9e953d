"""A training corpus from ``documents`` in five stages.

Each stage works on all rows its predecessor kept, is written as Parquet and
read again by the next.  All but the last return the columns of documents.

Defined cases, for every stage: rows are judged one by one by their text, so
null or repeated doc_ids lose no other row; a null text or one without letters
has no language and goes in the first stage, an empty table stays empty; extra
columns pass through the first four stages whatever their names, and the last
returns its own columns.  Of rows with equal sets of shingles one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import langid, lines, mixing, setjoin, winnow
from tracefold.llm.store import materialize, table

#: predictions below this are no language; a one-word text of a known one scores higher
MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language that the classifier knows."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    scored = langid.predict(rows, langid.fit(docs), ["row"], inside="row")
    return scored.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates; the documents stay."""
    free = lambda name: next(n for n in (name, *(f"{name}_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    n_lines, n_dropped = free("n_lines"), free("n_dropped")
    out = lines.drop_templates(docs, counts=(n_lines, n_dropped))
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.select(*[n_chars.alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of the n-gram Jaccard join."""
    return setjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of every document, and their place in the curriculum."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: the language classifier has no SQL form; tests/llm holds each other stage against SQL or brute force on its own input, and run() against the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
