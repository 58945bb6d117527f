"""Scalar and aggregate helpers whose meaning differs from Spark's defaults."""
