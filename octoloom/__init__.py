"""Byte-level content analysis and corpus preparation on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

#: Functions of this package travel to executors by value, so workers need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
