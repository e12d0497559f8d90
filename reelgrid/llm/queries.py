"""The llm queries of the driver contract: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import change_applier, decontaminate, embed_graph, filter_audit, html_extract, kneser_ney, line_chunks, mixing, ngram_join, substring, token_counts, token_output, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all embeddings."""
    return embed_graph.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removal of windows of 35 words that occur more than once."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the token files of all documents, computed from the files."""
    return token_output.encoded(_table(spark, sf_dir, "documents"), path=token_output.default_path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after removal of chunks of lines that occur before."""
    return line_chunks.remove_repeated_chunks(_table(spark, sf_dir, "documents"), with_text=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path=token_counts.default_path("piece_bpe_32k.model"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, with the item, the score and the place."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and groups of documents with Jaccard similarity 0.8 or more on five words."""
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents")).drop("key")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of each order, by language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sequenced_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each client change, applied in sequence by a stateful stream."""
    return change_applier.apply_changes(_table(spark, sf_dir, "client_changes"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OPERATORS = (
    op1_embedding_near_dedup,
    op2_substring_dedup,
    op3_source_mixing,
    op4_quality_classifier,
    op5_token_binary_output,
    op6_line_dedup,
    op7_token_counts,
    op8_benchmark_decontamination,
    op9_html_extraction,
    op10_ngram_jaccard_join,
    op11_filter_interaction_audit,
    op12_sequenced_change_applier,
    op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.ORACLE, "op11_filter_interaction_audit": filter_audit.ORACLE}
