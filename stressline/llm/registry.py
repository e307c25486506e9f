"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, prefix_trie, ranked_search, url_filters, warc
from .exact_dedup import exact_groups
from .hilbert_shards import document_shards
from .jaccard_join import jaccard_classes
from .media import media_columns
from .packing import pack_documents
from .prefix_trie import conversation_trie
from .quality import score_quality
from .ranked_search import rank_documents
from .repeated_spans import remove_repeats
from .source_mixing import mix_digest
from .toxicity import score_toxicity
from .url_filters import filter_urls, tracked_links
from .warc import capture_histories


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(_table(spark, sf_dir))


def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_histories(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir), with_media=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir), tokenizer=tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return filter_urls(pages, tracked_links(pages)).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_classifier, op2_source_mixing, op3_hilbert_sharding, op4_warc_index_merge, op5_media_columns, op6_ngram_jaccard_join, op7_toxicity_pu, op8_packing, op9_exact_dedup, op10_suffix_array_dedup, op11_ranked_search, op12_conversation_prefix_trie, op13_url_filters)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_index_merge": warc.ORACLE_SQL, "op6_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL, "op12_conversation_prefix_trie": prefix_trie.ORACLE_SQL, "op13_url_filters": url_filters.ORACLE_SQL}
