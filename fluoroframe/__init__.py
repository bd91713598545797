"""Fluorescence-microscopy analytics as PySpark DataFrame operators.

Every public function takes and returns DataFrames and accepts many images at
once.  See README.md for the table layouts and the list of operators.
"""

import sys

from pyspark import cloudpickle

# Kernels travel with the plan, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
