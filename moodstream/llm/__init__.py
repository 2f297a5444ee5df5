"""Operators for preparing large training corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Python workers get the operators' functions with the job, so the package need not be on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
