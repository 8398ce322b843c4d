"""registra: Spark-first operators that turn recognised text into a trusted register."""

import sys

from pyspark import cloudpickle

# functions for executors travel by value, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
