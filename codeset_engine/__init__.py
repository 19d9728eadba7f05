"""PySpark engine for yearly code sets and the documents around them."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
