"""Process-record analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
