"""A text-retrieval, document-analytics and training-data engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the tasks and needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
