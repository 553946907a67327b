"""Swelter: gridded extremes analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that tasks run travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
