"""Offer data and training data on Spark: evidence extraction, normalisation, dedup, scoring.

Functions of this package travel to executors by value, so a cluster needs no installation.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
