"""Queries over the training-data operators: each applies one operator, with production
parameters, to its whole table and keeps the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, filter_audit, mixing
from .common import table
from .decontaminate import decontaminate
from .jaccard_join import jaccard_components
from .quality_crf import score_quality
from .rabitq import near_vectors
from .suffix_dedup import remove_repeats
from .token_align import align_tokens
from .toxicity_fm import score_toxicity
from .url_words import judge_urls
from .warc_segments import archive_round_trip
from .zstd_secrets import scan_secrets

QUERIES: dict = {}
SQL: dict[str, str] = {"op9_source_mixing": mixing.SQL, "op11_filter_audit": filter_audit.SQL, "op12_chat_format": chat_format.SQL}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(spark, table(spark, sf_dir, "documents"), with_kept=False)
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


@_query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_rabitq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


@_query
def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


@_query
def op5_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (scan_secrets(spark, table(spark, sf_dir, "documents"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))


@_query
def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (archive_round_trip(spark, table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@_query
def op7_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@_query
def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_sources(spark, table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (filter_audit.filter_audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select("part", "filter_order", "step", *filter_audit.MEASURES))


@_query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.probe(spark, table(spark, sf_dir, "conversations"))
    return (chat_format.read_back(chat_format.format_chats(spark, turns), together=True)
            .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = align_tokens(spark, table(spark, sf_dir, "documents"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
