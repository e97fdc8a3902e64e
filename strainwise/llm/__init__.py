"""Operators for building training data from text, pages, chats and vectors; ``catalog`` registers them.

Functions of this subpackage travel to the executors by value, so that they need not
have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
