"""Spark-native engine for declared dataflow pipelines and citation-graph analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
