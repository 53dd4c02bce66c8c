"""Operators for preparing training text; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions that run in tasks carry their code with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
