"""Training-data operators.  Nothing outside this subpackage imports it.

The task functions of the operators are shipped to the executors by value, so
a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
