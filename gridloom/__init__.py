"""Spark-native cleaning, union, de-duplication and summarising of tabular files.

Every operator takes and returns a Spark ``DataFrame`` and stays lazy; only
sinks and file discovery run jobs.
"""

import sys

from pyspark import cloudpickle

from gridloom.session import build_session

# Tasks get our helper functions with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
