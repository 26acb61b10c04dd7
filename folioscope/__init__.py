"""Documentation retrieval on Spark: ingest, index, search and evaluate with DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
