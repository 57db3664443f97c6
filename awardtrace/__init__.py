"""Reconcile research-grant assertions at scale, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Spark's Python workers by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
