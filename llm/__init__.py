"""Operators for preparing training data, one module each; nothing else in the library imports them.

Functions that run in tasks ship with their code, as in the rest of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
