"""Corpus operators for training data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
