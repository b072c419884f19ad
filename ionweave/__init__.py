"""Spark-native spectral-library search engine."""

import sys

from pyspark import cloudpickle

# Workers get functions of this package by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
