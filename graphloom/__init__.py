"""Graph recommendation and data-processing engine expressed on the PySpark DataFrame API."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# the functions that run in Python workers travel with their tasks, so executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])
