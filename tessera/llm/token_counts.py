"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, raw, slices, stage
from tessera.llm.encode import encoder

#: Lengths of a block; sums over blocks come first, then those within each.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. Null text has length 0."""
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes = np.array([len(x) // 4 for x in encoder(tokenizer).encode(raw(part.column("text")))], np.int64)
            n, k = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k.astype(np.int64))], ["n_tokens", "n_docs"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(work, "n_tokens bigint, n_docs bigint")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per encoded length that occurs, read as a context limit.

    n_docs documents of that length; docs_within and tokens_within of those up to it; docs_beyond and
    tokens_beyond of the longer ones; truncated_tokens, the total if every document is cut to the limit;
    quantile, the share of documents up to it; total_docs and total_tokens of all.
    Sums go over blocks of BLOCK lengths first, so no task sees all lengths. Null text has length 0, repeated rows count
    each, other columns aren't read, and an empty table gives no rows.
    """
    hist = stage(length_histogram(docs, tokenizer, text_col).withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "lengths")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = hist.select("*", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("di"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)).alias("ti"))
    joined = summed.join(blocks, "block").select("n_tokens", "n_docs", (F.col("d") + F.col("di")).alias("docs_beyond"), (F.col("t") + F.col("ti")).alias("tokens_beyond"), "total_docs", "total_tokens")
    return joined.select(
        "n_tokens", "n_docs",
        (F.col("total_docs") - F.col("docs_beyond")).alias("docs_within"),
        (F.col("total_tokens") - F.col("tokens_beyond")).alias("tokens_within"),
        "docs_beyond", "tokens_beyond",
        (F.col("total_tokens") - F.col("tokens_beyond") + F.col("docs_beyond") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_beyond")) / F.col("total_docs")).alias("quantile"),
        "total_docs", "total_tokens",
    )


def total(counts: DataFrame, limit: int) -> DataFrame:
    """One row: docs_beyond, tokens_beyond and truncated_tokens at any context limit, from the rows of token_counts()."""
    longer = F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)
    return counts.agg(
        F.coalesce(F.sum(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum(longer * F.col("n_tokens")), F.lit(0)).alias("tokens_beyond"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
    )


def quantile(counts: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that the given share of the documents doesn't exceed."""
    return counts.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with its suffix sums."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
