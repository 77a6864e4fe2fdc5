"""trackspark: object-track event analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python tasks carry this package's own functions with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
