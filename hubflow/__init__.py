"""hubflow: logistics-network delay analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers, adapters, sinks), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame operators),
``plans`` (the registered queries and their SQL oracles) and
``streaming`` (incremental hub KPIs with Structured Streaming).
"""

__version__ = "0.1.0"
