"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage, so it can be removed as a whole. Functions that run on
executors are pickled by value: executors need the third-party wheels only, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
