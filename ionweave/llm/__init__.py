"""Operators for text-corpus preparation. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
