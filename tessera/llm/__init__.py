"""Training-data operators. Nothing outside this subpackage imports it.

The functions that run in Python workers are shipped by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
