"""Operators for preparing training data. Nothing else in the library imports this package.

Functions of this package travel to the executors by value, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
