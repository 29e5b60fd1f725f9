"""The training-data pipeline: each stage calls one operator of ``tidewatch.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in
the shared scratch folder and reads it again as the next stage's docs.  All stages but the last return the
columns of ``documents``; the last returns the mix: one row per document with the words taken from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import column, drop, materialise, table
from tidewatch.llm.decontaminate import decontaminate
from tidewatch.llm.jaccard_join import one_of_each
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.quality_crf import score_quality
from tidewatch.llm.zstd_secrets import scan_secrets


def _others(docs: DataFrame, *out: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", *out))


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, out of the struct in which an operator kept them."""
    return found.select("doc_id", *(["kept.*"] if "kept" in found.columns else []), *([c for c in found.columns if c == "text"])).select(
        *(column(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go.  Null and empty texts are scored as one empty line; repeated rows score alike,
    ties at 0.5 stay; an empty table stays empty.  Any further columns, whatever their names, are passed on."""
    scored = score_quality(spark, docs, table(spark, sf_dir, "labels"), keep=_others(docs))
    return _columns(scored.where("predicted = 1"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id, null ids last, ties by a hash of the text.
    Rows without words (null, empty) link with nothing and stay; fully repeated rows stay once; an empty table stays empty."""
    return one_of_each(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.  Null and empty texts hold none and stay; repeated rows share one fate;
    an empty table stays empty.  Any further columns are passed on."""
    found = decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), keep=_others(docs))
    return _columns(found.where("not contaminated"), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; ``n_chars``, where there is such a column, is counted anew.  Every row stays: null texts
    stay null, empty texts empty, repeated rows change alike.  Any further columns are passed on."""
    found = scan_secrets(spark, docs, with_redacted=True, keep=_others(docs, "text"))
    out = _columns(found.withColumn("text", F.col("redacted")), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words taken from each.  Null and empty texts have no words and are never taken; a null
    source is a source of its own; repeated rows are taken each; an empty table gives an empty mix."""
    return mix_sources(spark, docs).where("taken > 0")


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("source_mixing", source_mixing)]

ORACLE_SQL = None  # classifier and components are not SQL; tests/llm/test_pipeline.py holds every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
