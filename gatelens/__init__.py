"""Batch audit of model responses on Spark: gates, robust signals, thresholds, scores and triage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that workers needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
