"""Operators for preparing training data: quality, duplicates, privacy, token counts, mixing and packing.

Functions of this package travel to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
