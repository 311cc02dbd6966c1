"""Operators for training-data pipelines over tables of documents and vectors.

Functions that run inside tasks are shipped by value, so executors need numpy,
pandas, pyarrow, xxhash and tiktoken, but no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
