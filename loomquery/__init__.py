"""loomquery: a Spark-native engine for archive search, relations, pipelines and dashboards."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
