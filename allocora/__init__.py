"""Allocora: panel allocation analytics on Spark.

Every public function takes and returns DataFrames. Column names are
parameters; the defaults ``unit`` and ``period`` name the panel key.
"""
