"""See the package README."""

import sys

from pyspark import cloudpickle

# Workers get these modules' functions by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
