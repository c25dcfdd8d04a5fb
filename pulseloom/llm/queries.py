"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.llm import bpe, centroid_clusters, feistel_order, kneser_ney, length_histogram, quote_links, robust_quality, rp_forest, sentencepiece_unigram, simhash_trie, suffix_groups, tier_packing, toxicity_fst, whitening
from pulseloom.llm.store import stored
from pulseloom.session import table


def op1_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by Unigram Viterbi and decoded again; ids as counts and checksums."""
    pieces = sentencepiece_unigram.Pieces.load(bpe.vocabulary_path("piece_bpe_32k.model"))
    return sentencepiece_unigram.encode_documents(table(spark, sf_dir, "documents"), pieces, with_ids=False)


def op2_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents."""
    return robust_quality.quality_verdicts(table(spark, sf_dir, "documents")).drop("distance")


def op3_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the clause grammar."""
    return toxicity_fst.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores of all documents, learned from those that aren't held out."""
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op5_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return tier_packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, linked by their quotes; own texts as length and checksum."""
    return quote_links.digest(quote_links.reply_order(table(spark, sf_dir, "conversations")))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all conversations with their turns made to quote earlier ones: the table's own hardly quote."""
    made = spark.sql(quote_links.quoting("{conversations}"), conversations=table(spark, sf_dir, "conversations"))
    return quote_links.digest(quote_links.reply_order(made))


def op7_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences in a keyed training order, written as fixed-stride shards."""
    return feistel_order.materialise(table(spark, sf_dir, "documents"))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return rp_forest.forest_components(table(spark, sf_dir, "embeddings"))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    return simhash_trie.simhash_components(table(spark, sf_dir, "documents"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums."""
    histogram = stored(length_histogram.length_counts(table(spark, sf_dir, "documents")), "lengths")
    return length_histogram.suffix_sums(histogram)


def op11_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that a smaller id has; kept texts as checksums."""
    found = suffix_groups.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All complete embeddings in sixteen clusters."""
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight principal components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sentencepiece_unigram": op1_sentencepiece_unigram,
    "op2_robust_quality": op2_robust_quality,
    "op3_toxicity_fst": op3_toxicity_fst,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_tier_packing": op5_tier_packing,
    "op6_quote_links": op6_quote_links,
    "quoted_replies": quoted_replies,
    "op7_feistel_order": op7_feistel_order,
    "op8_rp_forest": op8_rp_forest,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_length_histogram": op10_length_histogram,
    "op11_suffix_groups": op11_suffix_groups,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op12_centroid_clusters": centroid_clusters.reference_sql(),
    "op6_quote_links": quote_links.reference_sql(),
    "quoted_replies": quote_links.reference_sql(f"({quote_links.quoting()}) q"),
    "op2_robust_quality": f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({robust_quality.reference_sql()}) q",
}
