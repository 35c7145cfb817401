"""tsveil: publishing tables of time series under (k, P)-anonymity with l-diversity, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The package's functions travel inside the tasks that use them, so executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
