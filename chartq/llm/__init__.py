"""Operators for large training-data pipelines (one module per operator).

Python functions of this package travel to the executors by value, so a cluster needs only the
libraries they use, not this repository, on its machines. What is broadcast is plain data.
"""

import sys

from pyspark import cloudpickle

from chartq import session

# `session` too: modules that travel refer to it
for module in (sys.modules[__name__], session):
    cloudpickle.register_pickle_by_value(module)
