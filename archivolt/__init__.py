"""archivolt - document-archive analytics on PySpark.

Operators take and return DataFrames (or Columns) and are grouped into
``sources`` (readers and writers), ``functions`` (Column expressions),
``operators`` (joins, linkage, spatial, graph, retrieval), ``streaming``
(event-time and stateful operators) and ``plans`` (the query catalogue).
The optional subpackage ``llm`` holds operators for training-data pipelines;
nothing outside it imports it.
"""

__version__ = "0.1.0"
