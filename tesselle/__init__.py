"""tesselle: corpus search, refinement and analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the library's functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
