"""Market-bar analytics as Spark DataFrame operators keyed by symbol."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
