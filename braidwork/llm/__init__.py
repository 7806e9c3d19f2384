"""Operators for preparing training data: ten operators, their queries (opN_...) and their SQL.

Nothing outside this subpackage imports it. ``queries`` collects what __spark_entry__.py registers.
"""

import sys

from pyspark import cloudpickle

# Workers get these modules' functions by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
