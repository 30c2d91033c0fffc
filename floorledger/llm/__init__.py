"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# What tasks run travels with them, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
