"""Spark-native corpus preparation, audit and evaluation engine."""

import sys

from pyspark import cloudpickle

# Ship our own functions to executors by value: no package install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
