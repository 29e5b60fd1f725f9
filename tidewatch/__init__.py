"""tidewatch — Spark-native security-telemetry analytics.

Ingest, data quality, profiling, reporting SQL, feature pipelines,
supervised and unsupervised detectors, evaluation statistics and
streaming scoring, all expressed as DataFrame / Spark SQL / pyspark.ml
jobs.
"""

__version__ = "0.1.0"
