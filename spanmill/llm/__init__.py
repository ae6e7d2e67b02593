"""Operators for preparing training data of language models, each by one named method."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
