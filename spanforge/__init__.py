"""spanforge: a PySpark-native engine for evaluating document retrieval by source spans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
