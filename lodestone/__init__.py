"""Lodestone: a Spark-native engine for investigative analytics over messy records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: no cluster needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
