"""Operators of a training-data pipeline over documents, embeddings and pages.

Functions of this package are shipped to the executors by value, so jobs run from any
folder and need no installation of the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
