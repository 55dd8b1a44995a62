"""Spark-native registration and evaluation of grids of overlapping image tiles."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so it needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
