"""Operators for preparing training text; nothing else in the package imports this folder.

Functions that run on workers travel by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
