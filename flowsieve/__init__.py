"""flowsieve: network-flow analytics as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
