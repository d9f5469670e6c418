"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; it may be deleted whole.
Every operator takes a DataFrame and returns a DataFrame; ``queries`` binds them
to the tables of a data folder.
"""
