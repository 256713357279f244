"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the shared folder that
``spark.checkpoint.dir`` names (see :mod:`tarnflow.llm.shared`).
"""
