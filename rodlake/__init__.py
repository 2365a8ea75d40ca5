"""rodlake: analytics over large sets of rod-like particles, and corpus operators, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
