"""Operators of a training-data pipeline, on the same Spark session as the rest.

Functions of this package that run in tasks are sent to the executors with the
job, so a worker needs no copy of the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
