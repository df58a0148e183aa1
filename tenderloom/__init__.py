"""Procurement and operations analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames. Money travels as BIGINT cents
(``*_cents``); decimals appear only where data enters or leaves the library.
"""

__version__ = "0.1.0"
