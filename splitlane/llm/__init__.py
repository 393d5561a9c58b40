"""Operators for preparing large text collections as training data.

Functions of this package travel to the executors by value, so that it need not be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
