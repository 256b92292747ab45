"""corpusloom: text-corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package reach the executors by value, so that these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
