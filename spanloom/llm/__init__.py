"""Operators of a training-data pipeline: each module is one operator, ``registry`` holds their queries.

The functions that run inside tasks travel with the plan (pickled by value), so
executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
