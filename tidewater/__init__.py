"""Tidewater: a Spark-native retail analytics and training-data engine."""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers by value, so executors
# need Spark and the libraries used, not a copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
