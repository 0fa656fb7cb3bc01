"""Survey calibration analytics on Spark: profiling, retrieval, sampling, calibration and validation as DataFrame operators.

Functions that run in tasks are shipped to the executors by value, so a cluster
needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
