"""Grouped signals, sparse counts and spatial points on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so it needs no installation on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
