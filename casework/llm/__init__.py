"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
