"""Operators for training-data pipelines. Nothing outside this package imports it.

The package's functions are pickled by value, so executors need no installed copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
