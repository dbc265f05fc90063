"""Plant telemetry analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from plantlytics.roles import Roles, resolve_roles
from plantlytics.session import configure, get_spark

# The few functions that run inside Python workers travel with their task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles", "configure", "get_spark", "resolve_roles"]
