"""Multilingual corpus preparation, growth and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run in Python workers travel with the job: executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
