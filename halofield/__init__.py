"""Spatial source-target analytics as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their module with them, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
