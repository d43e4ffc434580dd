"""Listing integration, faceted analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a job runs without
# installing the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
