"""Job-posting analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
