"""lectern: document preparation, batch retrieval and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the pickled function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
