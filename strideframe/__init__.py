"""PySpark-native analytics for video-derived motion datasets.

Everything is a function from DataFrames to DataFrames; no global session and
no hidden actions in the query operators.
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
