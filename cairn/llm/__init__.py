"""Operators for building training corpora; nothing else in the package imports this one.

Their functions go to the executors by value, so that this package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
