"""Analytics over security event logs, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that the
# package need not be installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
