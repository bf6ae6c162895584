"""Vector search and analytics operators as plain PySpark DataFrame programs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Task functions travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
