"""Review-grounded retrieval and recommendation analytics on Spark.

The package's functions are sent to Python workers by value, so executors need the
third-party libraries but not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
