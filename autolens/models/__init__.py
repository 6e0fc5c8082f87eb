"""Baseline models on Spark ML."""
