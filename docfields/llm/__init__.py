"""Operators for building training corpora; nothing else in the package imports this folder.

Functions of this folder that run in Python tasks travel by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
