"""Quotation-matching analytics on Spark DataFrames.

Sub-packages: ``functions`` (Column builders), ``sources`` (readers and table
views), ``operators`` (DataFrame -> DataFrame), ``plans`` (registered queries
and end-to-end flows) and ``streaming`` (Structured Streaming wrappers).
"""

from tendril.session import build_session

__all__ = ["build_session"]
