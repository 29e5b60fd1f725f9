"""Operators: reporting, data quality, profiling, metrics, features,
supervised and unsupervised models, resampling."""
