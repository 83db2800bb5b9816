"""Lossless integer analytics on Spark: residual codes, bit signals, scans and range coding."""
