"""A PySpark-native engine to verify, join, grid and clean space-time data."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions go to the executors with their code, so that the package needn't be installed there.
register_pickle_by_value(sys.modules[__name__])
