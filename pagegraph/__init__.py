"""Spark-native operators that turn web pages into a queryable graph of facts."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the plan, so that
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
