"""Operators of a large-scale training-data pipeline.  Nothing else in the library imports this subpackage.

Task functions of this subpackage are pickled by value, so executors need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
