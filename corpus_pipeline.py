"""From raw documents to packed token sequences, in four stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of their input. ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's input, so a lost executor repeats a
part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import robust_quality, shingle_sets, tier_packing, toxicity_fst
from pulseloom.llm.store import stored
from pulseloom.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie near their group's robust centre."""
    return robust_quality.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, trained on the labelled ones among them, doesn't call toxic."""
    model = toxicity_fst.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_fst.score_column(model) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle sets of Jaccard similarity 0.8 or more: candidates by the SimHash trie join and by bands, verified exactly."""
    return shingle_sets.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return tier_packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: Scores and fingerprints can't be expressed in SQL: tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
