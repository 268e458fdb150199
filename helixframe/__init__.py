"""helixframe: sequence analytics as functions from DataFrame to DataFrame.

Functions of this package travel to executors by value, so a cluster need not have it installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
