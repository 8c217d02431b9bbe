"""Aerial-survey analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames, works on many flights,
clouds, videos or scenes at once, and reports bad groups as rows instead of
raising in the middle of a job.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel with the job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
