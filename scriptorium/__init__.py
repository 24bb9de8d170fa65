"""Document-retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# UDF bodies travel to the executors by value, so a job also runs where the
# package itself is not installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
