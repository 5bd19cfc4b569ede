"""Spark-native analytics for event-timestamp (spike-train) data."""

import sys

from pyspark import cloudpickle

# Python functions reach the executors with this package's code inside them, so it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
