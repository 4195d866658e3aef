"""Indicator scoring on PySpark: DataFrame-in, DataFrame-out operators.

Sub-packages
    functions   Column builders (codes, cleaning, scoring, predicates, geo, text)
    operators   DataFrame operators (joins, aggregates, ranks, quality, models ...)
    sources     readers, sinks, contracts and the raw source registry
    plans       staging, silver and gold models composed from the operators
    streaming   Structured Streaming ingest, windows and per-key state
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
