"""Operators that prepare training text: deduplication, filtering, privacy, language, tokens. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task functions travel whole, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
