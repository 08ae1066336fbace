"""Experiment and telemetry analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Nothing here keeps a
global session; the session always comes from the caller's DataFrame.
"""

import sys

from pyspark import cloudpickle

# The few pandas functions of this package travel to the executors by value, so
# a cluster needs no installed copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
