"""Prompt-security analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
