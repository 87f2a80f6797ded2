"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import lodestone.llm as _self

# Functions of this package travel to the workers by value: no cluster needs it installed.
cloudpickle.register_pickle_by_value(_self)
