"""Exact histogram of encoded document lengths, and what its suffix sums answer.

Workers encode whole texts and send only (length, documents) pairs, merged in each
batch, before the one shuffle. The histogram has as many rows as there are distinct
lengths. Suffix sums run over blocks of lengths: inside each block by a window of
bounded size, and over the blocks' totals, of which there are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulseloom.llm import bpe


def length_counts(docs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``(length, n_docs)``: null and empty texts have length 0; repeated rows count each; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, counts = np.unique(np.array([bpe.count(t.as_py() or "", vocabulary) for t in batch.column(0)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(counts.astype(np.int64))], names=["length", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "length long, n long")
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """``(length, n_docs)`` to one row for each length with the sums over longer documents.

    docs_ge, tokens_ge: documents at least as long, and their tokens. docs_total,
    tokens_total: of the whole table. truncated_total: tokens kept when ``length`` is
    the context limit. share_le: share of documents no longer than this (the quantile).
    """
    tokens = F.col("length") * F.col("n_docs")
    rows = histogram.select("length", "n_docs", F.floor(F.col("length") / block).cast("long").alias("block"), tokens.alias("tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # one row for each block of lengths: bounded by the longest text over the block size
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"), F.sum("bd").over(every).alias("docs_total"), F.sum("bt").over(every).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(blocks, "block")
    sums = sums.withColumns({"docs_ge": F.col("d") + F.col("docs_after"), "tokens_ge": F.col("t") + F.col("tokens_after")})
    return sums.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_ge") + F.col("n_docs")) / F.col("docs_total")).alias("share_le"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents that exceed it, tokens kept by truncation, tokens lost; from ``suffix_sums``, whose first
    length beyond a limit holds the sums over all longer documents. One pass, one row. An empty table gives zeros."""
    beyond = [F.min(F.when(F.col("length") > int(x), F.struct("length", "docs_ge", "tokens_ge"))).alias(f"_{k}") for k, x in enumerate(limits)]
    found = sums.agg(F.max("tokens_total").alias("tokens_total"), *beyond)
    each = F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.col(f"_{k}").alias("at")) for k, x in enumerate(limits)]))
    rows = found.select(F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"), each.alias("e")).select("tokens_total", "e.context_limit", F.coalesce("e.at.docs_ge", F.lit(0)).alias("docs_over"), F.coalesce("e.at.tokens_ge", F.lit(0)).alias("tokens_over"))
    lost = F.col("tokens_over") - F.col("context_limit") * F.col("docs_over")
    return rows.select("context_limit", "docs_over", (F.col("tokens_total") - lost).alias("truncated_total"), lost.alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share, the least length that at least that share of the documents doesn't exceed (from ``suffix_sums``)."""
    each = sums.select("length", "share_le", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return each.where("share_le >= share").groupBy("share").agg(F.min("length").alias("length"))
