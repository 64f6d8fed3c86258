"""tickloom: market-data features and risk analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tickloom.session import build_session, prepare

# Functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "prepare"]
