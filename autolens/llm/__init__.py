"""Operators for the preparation of training corpora.

Nothing else in the library imports this package. The operators take and return
DataFrames; `queries` binds them to the tables of a folder.
"""
