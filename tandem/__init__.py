"""Analysis of paired, repeated-run experiments on Spark.

Functions of this package that run inside Spark tasks are shipped by value, so
executors need no installed copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
