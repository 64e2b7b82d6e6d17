"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions that run inside Spark's Python tasks are sent by value, so the
executors need the third-party packages but not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
