"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated to one row for each encoded length.  Suffix sums over
that histogram give, for every context limit, how many documents are longer,
how many tokens there are in all and how many are left when documents are
truncated to the limit; prefix shares give quantiles.  The sums are two-level
(blocks of lengths, then within a block), so no task holds all lengths.

The tokenizer is one of the public vocabularies; its path is a parameter and
the file is read where the task runs.  Texts are encoded whole.

Defined cases: null and empty texts have length 0; very long texts are encoded
whole, one at a time; repeated rows count each; special-token strings are
ordinary text; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: splits text before merging; fixed by the public vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, length): tokens of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            lengths = [len(encode(t)) if t else 0 for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, length bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs, docs_at_least, tokens_at_least, total_docs, total_tokens, truncated_tokens, share_at_most) for each length that occurs.

    ``truncated_tokens`` is what is left of all tokens at a context limit of
    ``length``; ``share_at_most`` is the share of documents of at most that length.
    """
    hist = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    hist = materialize(hist, "length-histogram")
    tokens = F.col("n_docs") * F.col("length")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    zero = F.lit(0)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("_d").over(after), zero).alias("_d"),
        F.coalesce(F.sum("_t").over(after), zero).alias("_t"),
        F.sum("_d").over(whole).alias("total_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("_di", F.sum("n_docs").over(inside)).withColumn("_ti", F.sum(tokens).over(inside)).join(blocks, "block")
    docs_at_least, tokens_at_least = F.col("_di") + F.col("_d"), F.col("_ti") + F.col("_t")
    return rows.select(
        "length",
        "n_docs",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_at_least + docs_at_least * F.col("length")).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_at_least + F.col("n_docs")) / F.col("total_docs")).alias("share_at_most"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, total_tokens, truncated_tokens, docs_longer) for any context limits, from the suffix sums.

    The shortest length over a limit holds all that is longer: how many
    documents, and their tokens.
    """
    asked = sorted({int(x) for x in limits})
    over = [F.min(F.when(F.col("length") > x, F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"o{i}") for i, x in enumerate(asked)]
    one = histogram.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), *over)
    rows = [
        F.struct(
            F.lit(x).cast("bigint").alias("limit"),
            F.col("total").alias("total_tokens"),
            (F.col("total") - F.coalesce(F.col(f"o{i}.tokens_at_least"), F.lit(0)) + F.coalesce(F.col(f"o{i}.docs_at_least"), F.lit(0)) * x).alias("truncated_tokens"),
            F.coalesce(F.col(f"o{i}.docs_at_least"), F.lit(0)).alias("docs_longer"),
        )
        for i, x in enumerate(asked)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of documents do not exceed; no rows for an empty table."""
    asked = sorted({float(x) for x in shares})
    one = histogram.agg(*[F.min(F.when(F.col("share_at_most") >= x, F.col("length"))).alias(f"q{i}") for i, x in enumerate(asked)])
    rows = [F.struct(F.lit(x).alias("share"), F.col(f"q{i}").alias("length")) for i, x in enumerate(asked)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("length is not null")


def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
