"""Table, time-series and segment analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel whole, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
