"""Job-market and visa-sponsorship analytics as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel inside the task, so executors need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
