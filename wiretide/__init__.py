"""wiretide: field-bus capture analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the job itself, so executors
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
