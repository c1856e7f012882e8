"""Document retrieval and analytics on DataFrames.

Sub-packages: ``sources`` (tables, scans), ``functions`` (Column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (query plans, lineage cuts),
``streaming`` (Structured Streaming).  ``llm`` holds the operators for training
data and is optional: nothing outside it imports it.
"""
