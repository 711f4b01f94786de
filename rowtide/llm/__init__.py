"""Operators for preparing training text at scale.

Functions that run inside tasks are shipped to the executors with the job, so that
the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
