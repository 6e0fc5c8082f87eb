"""Automatic analysis of any Spark table."""
