"""rankloom: hybrid text retrieval and its evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
