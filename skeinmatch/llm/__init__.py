"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Worker processes need not have the repository on their path: what they run travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
